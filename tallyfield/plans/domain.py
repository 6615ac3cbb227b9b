"""Queries of the price, quality, money, decision and evaluation operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import register
from ..operators import decisions as dc
from ..operators import evaluate as ev
from ..operators import features as ft
from ..operators import intervals as iv
from ..operators import money as mn
from ..operators import prices as pr
from ..operators import quality as ql
from . import fixtures as fx
from .sqltext import with_views
from .windows import LATEST, label_sql

t = fx.table
KEYS = ["company_id", "trade_date"]
WIL = "CASE WHEN {n} > 0 THEN ({h} / {n} + 1.959963984540054 ** 2 / (2 * {n}) - 1.959963984540054 * sqrt({h} / {n} * (1 - {h} / {n}) / {n} + 1.959963984540054 ** 2 / (4 * {n} * {n}))) / (1 + 1.959963984540054 ** 2 / {n}) END"


def wil(h, n):
    return WIL.format(h=f"CAST({h} AS DOUBLE)", n=f"CAST({n} AS DOUBLE)")


def r6(df, *cols):
    kinds = dict(df.dtypes)
    return df.select(*[F.round(x, 6).alias(x) if kinds[x] == "double" else F.col(x) for x in (cols or df.columns)])




def some_sessions(s, d):
    return fx.attempts(s, d).where("job_run_id % 9 = 0").select(F.col("partition_key").alias("day")).distinct()


def listed(s, d):
    return fx.attempts(s, d).where("job_run_id % 501 = 0").select(F.col("partition_key").alias("day")).distinct()


def holiday_attempts(s, d):
    a = fx.attempts(s, d)
    return a.withColumn("status", F.when(F.dayofmonth("partition_key") % 3 == 0, "not_available").otherwise(F.col("status")))


register("c06_infer_holidays", lambda s, d: ql.infer_holidays(holiday_attempts(s, d), some_sessions(s, d).where(F.dayofmonth("day") % 3 != 0), listed(s, d).where(F.dayofmonth("day") % 2 == 0)), with_views("attempts") + """, a AS (SELECT * REPLACE (CASE WHEN day(partition_key) % 3 = 0 THEN 'not_available' ELSE status END AS status) FROM attempts),
l AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY source_id, partition_key ORDER BY started_at DESC, job_run_id DESC) = 1),
se AS (SELECT DISTINCT partition_key AS day FROM attempts WHERE job_run_id % 9 = 0 AND day(partition_key) % 3 <> 0), li AS (SELECT DISTINCT partition_key AS day FROM attempts WHERE job_run_id % 501 = 0 AND day(partition_key) % 2 = 0)
SELECT partition_key AS day FROM l GROUP BY 1 HAVING bool_and(status = 'not_available') AND isodow(partition_key) < 6 AND partition_key < (SELECT max(day) FROM se) AND partition_key NOT IN (SELECT day FROM se) AND partition_key NOT IN (SELECT day FROM li)""")
def calendar(s, d):
    """Every day of the months in which there were attempts."""
    first, last = fx.attempts(s, d).agg(F.trunc(F.min("started_at"), "month"), F.last_day(F.max("started_at"))).first()
    return ql.calendar_status(s, str(first), str(last), some_sessions(s, d), listed(s, d))


register("c07_calendar_status", calendar, with_views("attempts") + """, d AS (SELECT CAST(x AS DATE) AS day FROM (SELECT unnest(range(date_trunc('month', min(started_at)), date_trunc('month', max(started_at)) + INTERVAL 1 MONTH, INTERVAL 1 DAY)) AS x FROM attempts) r)
SELECT day, CASE WHEN day IN (SELECT partition_key FROM attempts WHERE job_run_id % 9 = 0) THEN 'session' WHEN day IN (SELECT partition_key FROM attempts WHERE job_run_id % 501 = 0) THEN 'holiday' WHEN isodow(day) >= 6 THEN 'weekend' ELSE 'expected' END AS status FROM d""")

# identity, actions, adjustment


def board_rows(s, d):
    x = fx.px(s, d).withColumn("row_id", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").cast("long"), F.col("l_quantity").cast("long")))
    return x.select(F.concat(F.lit("SYM"), (F.dayofyear("trade_date") % 10).cast("string")).alias("symbol"), "trade_date", F.when(F.col("l_returnflag") == "R", "BE").when(F.col("l_returnflag") == "A", "BZ").otherwise("EQ").alias("series"), "px", "row_id")


PREFER = lambda: F.when(F.col("series") == "EQ", 0).otherwise(1)
register("c09_company_prices", lambda s, d: pr.company_prices(board_rows(s, d), fx.symbol_map(s, d), ("EQ", "BE"), PREFER()).select("company_id", "trade_date", "series", "px"), with_views("px", "symbol_map") + """, b AS (SELECT concat('SYM', CAST(dayofyear(trade_date) % 10 AS VARCHAR)) AS symbol, trade_date, CASE l_returnflag WHEN 'R' THEN 'BE' WHEN 'A' THEN 'BZ' ELSE 'EQ' END AS series, px, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(trunc(l_extendedprice) AS BIGINT), CAST(trunc(l_quantity) AS BIGINT)) AS row_id FROM px)
SELECT m.company_id, trade_date, series, px FROM b JOIN symbol_map m ON b.symbol = m.symbol AND trade_date BETWEEN valid_from AND valid_to WHERE series IN ('EQ', 'BE') QUALIFY row_number() OVER (PARTITION BY m.company_id, trade_date ORDER BY CASE series WHEN 'EQ' THEN 0 ELSE 1 END, b.symbol, row_id) = 1""")
PARSE = with_views("action_text") + r""", c AS (SELECT p_partkey, company_id, lower(trim(unnest(string_split(replace(subject, '1:1/Dividend', '1:1|Dividend'), '|')))) AS x FROM action_text),
parsed AS (SELECT p_partkey, company_id, x, CASE WHEN x LIKE 'bonus%' THEN 'bonus' WHEN x LIKE 'face value split%' THEN CASE WHEN CAST(regexp_extract(x, 'to rs (\d+)', 1) AS DOUBLE) > 10 THEN 'consolidation' ELSE 'split' END WHEN x LIKE 'rights%' THEN 'rights' WHEN x LIKE 'demerger' THEN 'demerger' WHEN x LIKE '%dividend%' THEN 'dividend' ELSE 'other' END AS kind,
 CASE WHEN x = 'demerger' THEN 'unadjustable' WHEN x = 'interim dividend' THEN 'unparsed' WHEN x LIKE '%meeting%' THEN 'no_price_effect' ELSE 'parsed' END AS status,
 CASE WHEN x LIKE 'bonus%' THEN CAST(regexp_extract(x, '(\d+):(\d+)', 2) AS DOUBLE) / (CAST(regexp_extract(x, '(\d+):(\d+)', 1) AS DOUBLE) + CAST(regexp_extract(x, '(\d+):(\d+)', 2) AS DOUBLE)) WHEN x LIKE 'face value%' THEN CAST(regexp_extract(x, 'to rs (\d+)', 1) AS DOUBLE) / 10 END AS price_factor,
 CASE WHEN x LIKE '%dividend%' AND x <> 'interim dividend' THEN CAST(regexp_extract(x, 'rs (\d+)', 1) AS DOUBLE) END AS dividend_per_share,
 CASE WHEN x LIKE 'rights%' THEN CAST(regexp_extract(x, '1:(\d+)', 1) AS DOUBLE) END AS held FROM c)
"""
register("c11_parse_actions", lambda s, d: r6(pr.parse_actions(fx.action_text(s, d)).withColumn("held", F.when(F.col("kind") == "rights", F.col("ratio_held"))), "p_partkey", "kind", "status", "price_factor", "dividend_per_share", "held"), PARSE + "SELECT p_partkey, kind, status, round(price_factor, 6) AS price_factor, dividend_per_share, held FROM parsed")
register("c12_rights_factor", lambda s, d: fx.bars(s, d).select(*KEYS, F.round(pr.rights_factor(F.col("close"), F.lit(1.0), F.lit(3.0), F.col("low") * 0.8), 6).alias("factor")), with_views("bars") + "SELECT company_id, trade_date, round(least(1, (3 * close + low * 0.8) / 4 / close), 6) AS factor FROM bars")


def dated_actions(s, d):
    return fx.action_text(s, d).withColumn("ex_date", F.date_add(F.lit("1996-01-01").cast("date"), (F.col("p_partkey") % 900).cast("int")))


register("c13_build_events", lambda s, d: pr.build_events(dated_actions(s, d), fx.breaks(s, d).groupBy("company_id").agg(F.min("break_date").alias("first_break"))).select("company_id", "ex_date", "subject", "kind", "first_break"), PARSE.replace("parsed AS (SELECT p_partkey, company_id, x,", "parsed AS (SELECT p_partkey, company_id, x, ").replace(with_views("action_text"), with_views("action_text", "breaks")) + """, once AS (SELECT a.*, DATE '1996-01-01' + CAST(p_partkey % 900 AS INT) AS ex_date FROM action_text a QUALIFY row_number() OVER (PARTITION BY company_id, DATE '1996-01-01' + CAST(p_partkey % 900 AS INT), subject ORDER BY p_partkey) = 1),
fb AS (SELECT company_id, min(break_date) AS first_break FROM breaks GROUP BY 1) SELECT o.company_id, o.ex_date, o.subject, p.kind, fb.first_break FROM once o JOIN parsed p USING (p_partkey) LEFT JOIN fb ON fb.company_id = o.company_id""")
register("c14_build_factors", lambda s, d: r6(pr.build_factors(pr.build_events(dated_actions(s, d), fx.breaks(s, d).select("company_id").distinct()), fx.bars(s, d).select("company_id", "trade_date", "close"))), PARSE.replace(with_views("action_text"), with_views("action_text", "bars")) + r""", e AS (SELECT DISTINCT p.company_id, DATE '1996-01-01' + CAST(p.p_partkey % 900 AS INT) AS ex_date, a.subject, x, kind, status, price_factor, dividend_per_share, held, CAST(regexp_extract(x, 'premium rs (\d+)', 1) AS VARCHAR) AS prem FROM parsed p JOIN action_text a USING (p_partkey) WHERE status = 'parsed'),
j AS (SELECT e.*, b.close FROM e ASOF LEFT JOIN bars b ON e.company_id = b.company_id AND e.ex_date > b.trade_date),
f AS (SELECT company_id, ex_date, kind, CASE WHEN kind = 'rights' THEN least(1, (held * close + 30) / (held + 1) / close) ELSE price_factor END AS pf, CASE WHEN kind = 'dividend' AND dividend_per_share < close THEN 1 - dividend_per_share / close END AS df FROM j)
SELECT company_id, ex_date, round(product(coalesce(pf, 1)), 6) AS price_factor, round(product(coalesce(df, 1)), 6) AS dividend_factor, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM f WHERE pf IS NOT NULL OR df IS NOT NULL GROUP BY 1, 2""")
ADJ = with_views("factors") + """, cum AS (SELECT company_id, ex_date, exp(sum(ln(price_factor)) OVER w) AS f, exp(sum(ln(dividend_factor)) OVER w) AS df FROM factors WINDOW w AS (PARTITION BY company_id ORDER BY ex_date DESC)),
adj AS (SELECT b.*, coalesce(c.f, 1) AS f, coalesce(c.df, 1) AS df FROM bars b ASOF LEFT JOIN cum c ON b.company_id = c.company_id AND b.trade_date < c.ex_date)
"""
register("c15_adjusted_prices", lambda s, d: pr.adjusted_prices(fx.bars(s, d), fx.factors(s, d)).select(*KEYS, F.round("adj_close", 7).alias("adj_close"), F.round("adj_volume", 7).alias("adj_volume"), F.round("tr_close", 9).alias("tr_close")), ADJ + "SELECT company_id, trade_date, round(close * f, 7) AS adj_close, round(volume / f, 7) AS adj_volume, round(close * f * df, 9) AS tr_close FROM adj")
CONT = with_views("factors", "breaks") + """, a AS (SELECT f.*, b.close AS c0, b.trade_date AS d0 FROM factors f ASOF LEFT JOIN bars b ON f.company_id = b.company_id AND f.ex_date > b.trade_date),
z AS (SELECT a.*, b.close AS c1, b.trade_date AS d1 FROM a ASOF LEFT JOIN bars b ON a.company_id = b.company_id AND a.ex_date <= b.trade_date),
cont AS (SELECT company_id, ex_date, c1 / c0 - 1 AS raw_move, c1 / (c0 * price_factor) - 1 AS adj_move, abs(c1 / (c0 * price_factor) - 1) <= 0.20 + 0.10 / (c0 * price_factor) AS passed FROM z WHERE d1 - d0 <= 15 AND NOT EXISTS (SELECT 1 FROM breaks k WHERE k.company_id = z.company_id AND k.break_date = z.ex_date))
"""
cont = lambda s, d: pr.continuity_check(fx.bars(s, d), fx.factors(s, d), fx.breaks(s, d))
register("c16_continuity", lambda s, d: r6(cont(s, d)), CONT + "SELECT company_id, ex_date, round(raw_move, 6) AS raw_move, round(adj_move, 6) AS adj_move, passed FROM cont")
universe = lambda s, d: pr.build_universe(fx.bars(s, d), 10, 20, 0.5)
UNI = with_views("bars") + """, o AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS n FROM (SELECT DISTINCT trade_date FROM bars) x), m AS (SELECT strftime(trade_date, '%Y-%m') AS month, min(n) AS n0 FROM o GROUP BY 1 HAVING min(n) > 20),
u AS (SELECT month, company_id, median(value_inr) AS median_value_inr, count(*) AS sessions_traded, max(b.trade_date) AS as_of FROM m JOIN o ON n BETWEEN n0 - 20 AND n0 - 1 JOIN bars b ON b.trade_date = o.trade_date GROUP BY 1, 2 HAVING count(*) >= 10),
uni AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY median_value_inr DESC, company_id) AS rank FROM u) x WHERE rank <= 10)
"""
register("c17_build_universe", lambda s, d: universe(s, d).select("month", "company_id", F.round("median_value_inr", 4).alias("median_value_inr"), "sessions_traded", "as_of", "rank"), UNI + "SELECT month, company_id, round(median_value_inr, 4) AS median_value_inr, sessions_traded, as_of, rank FROM uni")

# samples
register("c22_weekly_dates", lambda s, d: ft.weekly_dates(fx.bars(s, d)), with_views("bars") + "SELECT CAST(date_trunc('week', trade_date) AS DATE) AS week, max(trade_date) AS trade_date FROM bars GROUP BY 1")
EVENTS = """, s AS (SELECT company_id, trade_date, CAST(trade_date AS TIMESTAMP) + INTERVAL 20 HOUR AS at_ FROM bars), fp AS (SELECT company_id, period_to, min(published_at) AS published_at FROM filings GROUP BY 1, 2),
since AS (SELECT s.company_id, s.trade_date, least(s.trade_date - CAST(max(fp.published_at) AS DATE), 200) AS days_since_results FROM s LEFT JOIN fp ON fp.company_id = s.company_id AND fp.published_at <= s.at_ GROUP BY s.company_id, s.trade_date),
ah AS (SELECT s.company_id, s.trade_date, least(min(meeting_date - s.trade_date), 45) AS results_ahead_days FROM s JOIN meetings m ON m.company_id = s.company_id AND m.is_results AND announced_at <= at_ AND meeting_date > s.trade_date GROUP BY 1, 2),
mv AS (SELECT company_id, trade_date AS session, close / lag(close) OVER (PARTITION BY company_id ORDER BY trade_date) - 1 AS move FROM bars),
rx AS (
  SELECT p.company_id, p.period_to, min(b.trade_date) AS session
  FROM fp p JOIN bars b ON b.company_id = p.company_id AND b.trade_date >= CAST(published_at AS DATE) + CASE WHEN CAST(published_at AS TIME) <= TIME '15:30:00' THEN 0 ELSE 1 END GROUP BY 1, 2),
lr AS (SELECT s.company_id, s.trade_date, max(rx.session) AS session FROM s JOIN rx ON rx.company_id = s.company_id AND rx.session <= s.trade_date GROUP BY 1, 2),
ev AS (
  SELECT s.company_id, s.trade_date, CAST(days_since_results AS INT) AS days_since_results, CAST(results_ahead_days AS INT) AS results_ahead_days,
         coalesce(results_ahead_days <= 7, false) AS results_this_week, round(move, 6) AS last_results_reaction
  FROM s JOIN since USING (company_id, trade_date) LEFT JOIN ah USING (company_id, trade_date) LEFT JOIN lr USING (company_id, trade_date) LEFT JOIN mv ON mv.company_id = s.company_id AND mv.session = lr.session)
"""
EVENT_COLUMNS = ("days_since_results", "results_ahead_days", "results_this_week", "last_results_reaction")


def event_features(s, d):
    bars = fx.bars(s, d)
    return r6(ft.event_features(bars.select(*KEYS), fx.meetings(s, d), fx.filings(s, d), bars.select(*KEYS, "close")).select(*KEYS, *EVENT_COLUMNS))


register("c27_event_features", event_features, with_views("bars", "filings", "meetings") + EVENTS + "SELECT * FROM ev")
register("c28_blocked_samples", lambda s, d: ft.blocked_samples(fx.bars(s, d).select(*KEYS), fx.flags(s, d), 14), with_views("flags") + "SELECT company_id, trade_date, EXISTS (SELECT 1 FROM flags f WHERE f.company_id = b.company_id AND severity = 'BLOCK' AND from_date <= trade_date + 14 AND to_date >= trade_date) AS blocked FROM bars b")
def weekly_samples(s, d):
    out = ft.weekly_samples(fx.panel(s, d), fx.market(s, d), universe(s, d), fx.meetings(s, d), fx.filings(s, d), fx.flags(s, d))
    return r6(out.select("company_id", "trade_date", "segment", "ret_20", "rank_ret_20", "max_gain_5", "label_a", "label_c", "days_since_results", "last_results_reaction", "breadth", "blocked"))


WEEKLY = UNI.replace(with_views("bars"), with_views("bars", "panel", "flags", "filings", "meetings"), 1).rstrip() + EVENTS.rstrip() + f""", la AS ({label_sql()}),
wd AS (SELECT max(trade_date) AS trade_date FROM bars GROUP BY date_trunc('week', trade_date)),
fe AS (
  SELECT company_id, trade_date, segment, close / lag(close, 20) OVER w - 1 AS ret_20,
         close / CASE WHEN count(close) OVER (PARTITION BY company_id, segment ORDER BY trade_date ROWS 49 PRECEDING) = 50 THEN avg(close) OVER (PARTITION BY company_id, segment ORDER BY trade_date ROWS 49 PRECEDING) END - 1 AS gap50
  FROM panel WINDOW w AS (PARTITION BY company_id, segment ORDER BY trade_date)),
me AS (
  SELECT fe.* FROM fe JOIN wd USING (trade_date) JOIN uni ON uni.company_id = fe.company_id AND uni.month = strftime(fe.trade_date, '%Y-%m'))
SELECT me.company_id, me.trade_date, me.segment, round(ret_20, 6) AS ret_20,
  round(CASE WHEN ret_20 IS NOT NULL THEN (rank() OVER (PARTITION BY me.trade_date ORDER BY ret_20 NULLS LAST) + (count(*) OVER (PARTITION BY me.trade_date, ret_20) - 1) / 2.0) / count(ret_20) OVER (PARTITION BY me.trade_date) END, 6) AS rank_ret_20,
  max_gain_5, label_a, label_c, days_since_results, last_results_reaction, round(avg(CAST(gap50 > 0 AS DOUBLE)) OVER (PARTITION BY me.trade_date), 6) AS breadth,
  EXISTS (SELECT 1 FROM flags f WHERE f.company_id = me.company_id AND severity = 'BLOCK' AND from_date <= me.trade_date + 14 AND to_date >= me.trade_date) AS blocked
FROM me LEFT JOIN la ON la.company_id = me.company_id AND la.segment = me.segment AND la.trade_date = me.trade_date
LEFT JOIN ev ON ev.company_id = me.company_id AND ev.trade_date = me.trade_date"""
register("c29_weekly_samples", weekly_samples, WEEKLY)
register("c30_horizon_samples", lambda s, d: r6(ft.horizon_samples(ft.compute_labels(fx.panel(s, d)), fx.panel(s, d), 0.15, 10), "company_id", "segment", "trade_date", "max_gain_10", "label_a", "label_c"), with_views("panel") + label_sql(0.15, 0.15, 10))

# money
FEE = "round({v} * 0.001 + {v} * 0.0000307 + {v} * 0.000001 + ({v} * 0.0000307 + {v} * 0.000001) * 0.18 + CASE WHEN {s} = 'BUY' THEN {v} * 0.00015 ELSE 0 END + CASE WHEN {s} = 'SELL' THEN 15.34 ELSE 0 END, 2)"
register("c33_order_charges", lambda s, d: mn.order_charges(fx.txns(s, d)).select("txn_id", F.round("stt", 8).alias("stt"), F.round(F.col("gst") + 1e-12, 8).alias("gst"), F.round("stamp", 8).alias("stamp"), "dp"), with_views("txns") + "SELECT txn_id, round(quantity * price * CAST(0.001 AS DOUBLE), 8) AS stt, round(quantity * price * (0.0000307 + 0.000001) * 0.18 + 1e-12, 8) AS gst, round(CASE WHEN side = 'BUY' THEN quantity * price * CAST(0.00015 AS DOUBLE) ELSE 0 END, 8) AS stamp, CASE WHEN side = 'SELL' THEN 15.34 ELSE 0 END AS dp FROM txns")
register("c34_term_and_tax", lambda s, d: fx.txns(s, d).select("txn_id", mn.holding_term(F.col("trade_date"), F.lit("1997-03-01").cast("date")).alias("long_term"), F.round(mn.estimated_tax(F.round(F.col("price") - 1400, 0), mn.holding_term(F.col("trade_date"), F.lit("1997-03-01").cast("date"))), 2).alias("tax")), with_views("txns") + ", x AS (SELECT txn_id, DATE '1997-03-01' > CASE WHEN month(trade_date) = 2 AND day(trade_date) = 29 THEN CAST(trade_date + INTERVAL 1 YEAR AS DATE) + 1 ELSE CAST(trade_date + INTERVAL 1 YEAR AS DATE) END AS long_term, round(price - 1400, 0) AS g FROM txns) SELECT txn_id, long_term, CASE WHEN g <= 0 THEN 0 ELSE round(g * CASE WHEN long_term THEN 0.125 ELSE 0.20 END, 2) END AS tax FROM x")
CUM = with_views("txns") + ", c AS (SELECT *, sum(quantity) OVER (PARTITION BY account, company_id, side ORDER BY trade_date, txn_id) AS upto FROM txns), b AS (SELECT * FROM c WHERE side = 'BUY'), s AS (SELECT * FROM c WHERE side = 'SELL')\n"
register("c35_fifo_lots", lambda s, d: mn.fifo_matches(fx.txns(s, d)).select("account", "company_id", "buy_id", "sell_id", "quantity", F.round("cost", 7).alias("cost"), F.round("proceeds", 7).alias("proceeds")), CUM + "SELECT b.account, b.company_id, b.txn_id AS buy_id, s.txn_id AS sell_id, CAST(least(b.upto, s.upto) - greatest(b.upto - b.quantity, s.upto - s.quantity) AS BIGINT) AS quantity, round((least(b.upto, s.upto) - greatest(b.upto - b.quantity, s.upto - s.quantity)) * b.price, 7) AS cost, round((least(b.upto, s.upto) - greatest(b.upto - b.quantity, s.upto - s.quantity)) * s.price, 7) AS proceeds FROM b JOIN s ON b.account = s.account AND b.company_id = s.company_id AND b.upto - b.quantity < s.upto AND s.upto - s.quantity < b.upto")
register("c36_validate_ledger", lambda s, d: mn.ledger_violations(fx.txns(s, d)), with_views("txns") + "SELECT * FROM (SELECT account, company_id, txn_id, CAST(sum(CASE side WHEN 'BUY' THEN quantity ELSE -quantity END) OVER (PARTITION BY account, company_id ORDER BY trade_date, txn_id) AS BIGINT) AS held FROM txns) x WHERE held < 0")
LOTS = CUM.rstrip() + ", sold AS (SELECT account, company_id, sum(quantity) AS sold FROM txns WHERE side = 'SELL' GROUP BY 1, 2), lots AS (SELECT b.account, b.company_id, b.txn_id, b.trade_date, b.price, least(b.quantity, greatest(b.upto - coalesce(sold, 0), 0)) AS quantity FROM b LEFT JOIN sold USING (account, company_id) WHERE least(b.quantity, greatest(b.upto - coalesce(sold, 0), 0)) > 0), lp AS (SELECT company_id, max_by(close, trade_date) AS close, max(trade_date) AS price_date FROM (SELECT company_id, trade_date, max_by(px, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)) AS close FROM px GROUP BY 1, 2) q GROUP BY 1)\n"
lots = lambda s, d: mn.open_lots(fx.txns(s, d))
latest = lambda s, d: mn.latest_prices(fx.bars(s, d))
register("c37_value_portfolio", lambda s, d: mn.value_portfolio(lots(s, d), latest(s, d), "2001-01-01").select("account", "company_id", "quantity", F.round("cost", 8).alias("cost"), F.round("value", 8).alias("value"), F.round("weight", 6).alias("weight"), "over_cap", "stale"), LOTS + ", v AS (SELECT account, l.company_id, CAST(sum(quantity) AS BIGINT) AS quantity, sum(quantity * price) AS cost, sum(quantity * close) AS value, max(price_date) AS pd FROM lots l JOIN lp ON lp.company_id = l.company_id GROUP BY 1, 2) SELECT account, company_id, quantity, round(cost, 8) AS cost, round(value, 8) AS value, round(value / sum(value) OVER (PARTITION BY account), 6) AS weight, round(value / sum(value) OVER (PARTITION BY account) * 100, 1) > 15 AS over_cap, pd < DATE '2000-12-25' AS stale FROM v")
register("c38_latest_prices", latest, with_views("bars") + "SELECT company_id, close, prev_close, trade_date AS price_date FROM (SELECT *, lag(close) OVER (PARTITION BY company_id ORDER BY trade_date) AS prev_close, row_number() OVER (PARTITION BY company_id ORDER BY trade_date DESC) AS rn FROM bars) x WHERE rn = 1")
MONEY = "SELECT c / 10.0 AS cutoff, avg(expected_gain) - 0.4 AS xirr, avg(expected_gain) - 0.41 AS xirr_stress, -c / 20.0 AS max_drawdown, count(*) AS years, count(*) FILTER (WHERE label) AS won FROM range(1, 10) g(c) JOIN scored ON p >= c / 10.0 GROUP BY c"


def money_results(s, d):
    cuts = s.range(1, 10).select((F.col("id") / 10).alias("cutoff"))
    j = F.broadcast(cuts).join(fx.scored(s, d), F.col("p") >= F.col("cutoff"))
    return j.groupBy("cutoff").agg((F.avg("expected_gain") - 0.4).alias("xirr"), (F.avg("expected_gain") - 0.41).alias("xirr_stress"), F.count("*").alias("years"), F.count(F.when(F.col("label"), 1)).alias("won")).withColumn("max_drawdown", -F.col("cutoff") / 2)


register("c64_accumulated_budget", lambda s, d: mn.accumulated_budget(fx.txns(s, d), 2000.0, "2001-01-01"), with_views("txns") + "SELECT account, 2000.0 * greatest(1, floor((DATE '2001-01-01' - max(trade_date)) / 7)) AS budget FROM txns WHERE side = 'BUY' GROUP BY 1")
def holding_states(s, d):
    bars = fx.bars(s, d)
    out = mn.holding_states(lots(s, d), latest(s, d), bars, "2001-01-01")
    return out.select(
        "account", "company_id", F.round(F.col("cost_per_share") + 1e-10, 8).alias("cost_per_share"), "last_close", "peak_close", "sessions_held",
        F.round("atr_14", 6).alias("atr_14"), F.round("net_profit_if_sold", 0).alias("net_profit_if_sold"),
    )


register("c70_holding_states", holding_states, with_views("txns", "bars") + LOTS[len(with_views("txns")):] + f""", fs AS (
  SELECT account, company_id, min(trade_date) AS bought, sum(quantity) AS q, sum(quantity * price) AS cost FROM lots GROUP BY 1, 2),
tr AS (
  SELECT company_id, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr, row_number() OVER (PARTITION BY company_id ORDER BY trade_date DESC) AS n
  FROM bars WINDOW w AS (PARTITION BY company_id ORDER BY trade_date)),
atr AS (SELECT company_id, CASE WHEN count(*) > 14 THEN avg(tr) FILTER (n <= 14) END AS atr_14 FROM tr GROUP BY 1),
h AS (
  SELECT f.account, f.company_id, q, cost, bought, lp.close AS last_close, max(b.close) AS peak_close, count(*) AS sessions_held
  FROM fs f JOIN lp ON lp.company_id = f.company_id JOIN bars b ON b.company_id = f.company_id AND b.trade_date >= bought GROUP BY ALL),
g AS (SELECT *, q * last_close - ({FEE.format(v="(q * last_close)", s="'SELL'")}) - cost AS gain,
  DATE '2001-01-01' > CASE WHEN month(bought) = 2 AND day(bought) = 29 THEN CAST(bought + INTERVAL 1 YEAR AS DATE) + 1 ELSE CAST(bought + INTERVAL 1 YEAR AS DATE) END AS long_term FROM h)
SELECT account, g.company_id, round(cost / q + 1e-10, 8) AS cost_per_share, last_close, peak_close, sessions_held, round(atr_14, 6) AS atr_14,
  round(gain - CASE WHEN gain <= 0 THEN 0 ELSE round(gain * CASE WHEN long_term THEN 0.125 ELSE 0.20 END, 2) END, 0) AS net_profit_if_sold
FROM g LEFT JOIN atr ON atr.company_id = g.company_id""")

# decisions


def states(s, d):
    b = fx.bars(s, d)
    return b.select(*KEYS, F.col("close").alias("last_close"), F.col("open").alias("cost_per_share"), (F.col("high") - F.col("low")).alias("atr_14"), F.col("high").alias("peak_close"), (F.col("close") - F.col("open") - 5).alias("net_profit_if_sold"), (F.dayofmonth("trade_date") % 9).alias("sessions_held"), (F.dayofyear("trade_date") % 2 == 0).alias("is_trade"), (F.dayofmonth("trade_date") == 13).alias("safety"), (F.dayofmonth("trade_date") == 14).alias("crash"))


RULES = "CASE WHEN dayofyear(trade_date) % 2 = 0 THEN concat_ws(',', CASE WHEN close <= open - 2 * (high - low) THEN 'stop_loss' END, CASE WHEN close <= high - 0.5 * (high - low) THEN 'trailing_stop' END, CASE WHEN close >= open * 1.1 AND close - open - 5 > 0 THEN 'target_reached' WHEN day(trade_date) % 9 >= 5 THEN 'time_stop' END) ELSE '' END"
ruled = lambda s, d: dc.exit_rules(states(s, d), trail_atr=0.5)
register("c45_exit_rules", lambda s, d: ruled(s, d).select(*KEYS, F.array_join("rules", ",").alias("rules")), with_views("bars") + f"SELECT company_id, trade_date, {RULES} AS rules FROM bars")
REVIEW = "(dayofyear(trade_date) % 2 <> 0 AND close / open - 1 <= -0.15)"
register("c46_review_regime_drawdown", lambda s, d: dc.drawdown_state(fx.bars(s, d)).join(states(s, d).select(*KEYS, dc.review_note(F.col("last_close"), F.col("cost_per_share"), F.col("is_trade")).alias("review_note")), KEYS).select(*KEYS, F.round("from_peak", 6).alias("from_peak"), "review", "pause_buys", "review_note", dc.market_regime(F.col("from_peak") + 0.1, -F.col("from_peak"), 0.3).alias("regime")), with_views("bars") + f", p AS (SELECT *, close / max(close) OVER (PARTITION BY company_id ORDER BY trade_date ROWS 125 PRECEDING) - 1 AS dd FROM bars) SELECT company_id, trade_date, round(dd, 6) AS from_peak, dd <= -0.08 AS review, dd <= -0.12 AS pause_buys, {REVIEW} AS review_note, CASE WHEN dd + 0.1 < 0 AND -dd >= 0.3 THEN 'stress' ELSE 'normal' END AS regime FROM p")
EDGE = "expected_gain - (" + FEE.format(v="{v}", s="'BUY'") + " + " + FEE.format(v="({v} * (1 + expected_gain))", s="'SELL'") + ") / {v} - 0.003"
register("c47_net_edge", lambda s, d: fx.scored(s, d).select("row_id", F.round(mn.net_edge(F.col("expected_gain"), F.lit(8123.0)), 6).alias("edge")), with_views("scored") + "SELECT row_id, round(" + EDGE.format(v="8123.0") + ", 6) AS edge FROM scored")
register("c48_plan_exits_holds", lambda s, d: dc.plan_exits(ruled(s, d).withColumn("review", dc.review_note(F.col("last_close"), F.col("cost_per_share"), F.col("is_trade")))).select(*KEYS, "action", "priority"), with_views("bars") + f", r AS (SELECT *, {RULES} AS rules, {REVIEW} AS review FROM bars) SELECT company_id, trade_date, CASE WHEN rules <> '' OR day(trade_date) IN (13, 14) THEN 'EXIT' WHEN review THEN 'REVIEW' ELSE 'HOLD' END AS action, CASE WHEN rules <> '' THEN 0 WHEN day(trade_date) = 13 THEN 1 WHEN day(trade_date) = 14 THEN 2 WHEN review THEN 3 ELSE 4 END AS priority FROM r")


def opportunities(s, d):
    budgets = fx.scored(s, d).groupBy(F.col("trade_date").alias("account")).agg((F.count("*") * 1000.0).alias("budget"))
    cand = fx.scored(s, d).where("p >= 0.8").select(F.col("trade_date").alias("account"), F.col("row_id").cast("string").alias("company_id"), (100 + F.col("row_id") % 700).cast("double").alias("close"), "expected_gain")
    return dc.plan_opportunities(cand, budgets, 4000.0, 3000.0)


register("c51_reason_drivers", lambda s, d: dc.reason_drivers(t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_tax", "l_discount"), {"l_tax": "tax", "l_discount": "discount"}).select("l_orderkey", "l_linenumber", "reason"), "SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > l_discount THEN concat_ws('; ', CASE WHEN l_tax > 0 THEN printf('tax %.2f', l_tax) END, CASE WHEN l_discount > 0 THEN printf('discount %.2f', l_discount) END) WHEN l_tax = l_discount THEN concat_ws('; ', CASE WHEN l_tax > 0 THEN printf('tax %.2f', l_tax) END, CASE WHEN l_discount > 0 THEN printf('discount %.2f', l_discount) END) ELSE concat_ws('; ', CASE WHEN l_discount > 0 THEN printf('discount %.2f', l_discount) END, CASE WHEN l_tax > 0 THEN printf('tax %.2f', l_tax) END) END AS reason FROM lineitem")
register("c52_goal_feasibility", lambda s, d: r6(dc.goal_feasibility(fx.bars(s, d), 0.05)), with_views("bars") + "SELECT company_id, round(avg(CAST(r >= 0.05 AS DOUBLE)), 6) AS rate, 'unlikely' AS band, round(pow(1.05, 12) - 1, 6) AS yearly FROM (SELECT company_id, close / lag(close, 21) OVER (PARTITION BY company_id ORDER BY trade_date) - 1 AS r FROM bars) x GROUP BY 1")
issued = lambda s, d: fx.scored(s, d).where("p >= 0.5").select("row_id", F.when(F.col("row_id") % 2 == 0, "A").otherwise("C").alias("signal"))
truth = lambda s, d: fx.scored(s, d).where("row_id % 5 <> 0").select("row_id", "label")
CARDS = with_views("scored") + ", i AS (SELECT row_id, CASE WHEN row_id % 2 = 0 THEN 'A' ELSE 'C' END AS signal FROM scored WHERE p >= 0.5), l AS (SELECT row_id, label FROM scored WHERE row_id % 5 <> 0), k AS (SELECT signal, count(*) AS issued, count(label) AS matured, count(*) FILTER (WHERE label) AS correct FROM i LEFT JOIN l USING (row_id) GROUP BY 1)\n"
register("c54_scorecards", lambda s, d: r6(dc.scorecards(issued(s, d), truth(s, d), ["row_id"])), CARDS + f"SELECT signal, issued, matured, correct, issued - matured AS pending, round(correct / matured, 6) AS precision, round({wil('correct', 'matured')}, 6) AS lower FROM k")
EDGES = (0.1, 0.2, 0.3, 0.5, 0.7)
_band = lambda op: " + ".join(f"CAST(p {op} {e} AS INT)" for e in EDGES)
register("c59_proposals", lambda s, d: dc.proposals(dc.scorecards(issued(s, d), truth(s, d), ["row_id"]), 30), CARDS + "SELECT signal, CASE WHEN matured < 30 THEN concat('keep ', signal, ': too few results') WHEN correct / matured < 0.5 THEN concat('switch off ', signal) ELSE concat('keep ', signal) END AS proposal FROM k")
alerts = lambda s, d: t(s, d, "events").select(F.col("event_id").alias("alert_id"), "ts", F.col("event_type").alias("kind"), F.concat_ws("-", "event_type", F.col("user_id").cast("string"), F.col("ts").cast("date").cast("string")).alias("dedupe_key"))
register("c62_redact_guard", lambda s, d: dc.redact_guard(fx.action_text(s, d), "subject").select("p_partkey", "has_amount"), with_views("action_text") + r"SELECT p_partkey, regexp_matches(subject, '(?i)(₹|\brs\.?|\binr)\s*-?\d') AS has_amount FROM action_text")
held = lambda s, d: fx.scored(s, d).select("row_id", "p", F.when(F.col("row_id") % 13 == 0, "EXIT").otherwise("HOLD").alias("action"), F.when(F.col("row_id") % 3 == 0, F.col("trade_date")).alias("reviewed"))
register("c63_confidence_buckets", lambda s, d: dc.confidence_buckets(held(s, d), 0.7, 400, "1999-01-01").select("row_id", "bucket"), with_views("scored") + "SELECT row_id, CASE WHEN row_id % 13 = 0 THEN 'sell' WHEN row_id % 3 = 0 AND DATE '1999-01-01' - trade_date < 400 THEN 'quiet' WHEN p >= 0.7 THEN 'sell_watch' ELSE 'hold' END AS bucket FROM scored")
register("c65_candidates", lambda s, d: fx.bars(s, d).join(latest(s, d).select("company_id", F.col("close").alias("last_close")), "company_id", "left").where("last_close is not null").select(*KEYS, F.round((F.col("high") - F.col("low")) / F.col("close") * F.col("last_close"), 4).alias("atr")), with_views("bars") + ", lp AS (SELECT company_id, max_by(close, trade_date) AS lc FROM bars GROUP BY 1) SELECT company_id, trade_date, round((high - low) / close * lc, 4) AS atr FROM bars JOIN lp USING (company_id)")
register("c67_fill_charges", lambda s, d: fx.txns(s, d).withColumn("charges", F.when(F.col("txn_id") % 2 == 0, 10.0)).select("txn_id", F.round(F.coalesce("charges", mn.charge_columns(F.col("side"), F.round(F.col("quantity") * F.col("price"), 0))["total"]), 1).alias("charges")), with_views("txns") + "SELECT txn_id, round(CASE WHEN txn_id % 2 = 0 THEN 10.0 ELSE " + FEE.format(v="round(quantity * price, 0)", s="side") + " END, 1) AS charges FROM txns")
register("c68_fresh_scores", lambda s, d: fx.scored(s, d).where(F.col("trade_date") == F.lit("1996-04-01").cast("date")).select("row_id", "p"), with_views("scored") + "SELECT row_id, p FROM scored WHERE trade_date = DATE '1996-04-01'")

# metrics
RANKSUM = "SELECT {by}((SELECT 0) + (sum(r * y) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * sum(1 - y), 0)) AS auc FROM (SELECT *, CAST(label AS INT) AS y, rank() OVER (PARTITION BY {part} ORDER BY p) + (count(*) OVER (PARTITION BY {part}, p) - 1) / 2.0 AS r FROM {src}) x {group}"
register("m09_auc", lambda s, d: r6(ev.auc(fx.scored(s, d))), with_views("scored") + "SELECT round(auc, 6) AS auc FROM (" + RANKSUM.format(by="", part="1", src="scored", group="") + ") z")
register("m10_average_precision", lambda s, d: r6(ev.average_precision(fx.scored(s, d))), with_views("scored") + ", k AS (SELECT p, count(*) AS n, count(*) FILTER (WHERE label) AS h FROM scored GROUP BY 1), c AS (SELECT h, sum(h) OVER (ORDER BY p DESC) / sum(n) OVER (ORDER BY p DESC) AS pr FROM k) SELECT round(sum(pr * h) / sum(h), 6) AS ap FROM c")
register("m11_top_k_precision", lambda s, d: r6(ev.top_k_precision(fx.scored(s, d))), with_views("scored") + "SELECT round(avg(CAST(label AS DOUBLE)), 6) AS top_k_precision FROM (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY trade_date ORDER BY p DESC, row_id) <= 5) x")
register("m12_brier", lambda s, d: r6(ev.brier(fx.scored(s, d))), with_views("scored") + "SELECT round(avg(pow(p - CAST(label AS INT), 2)), 6) AS brier FROM scored")
register("m13_calibration_table", lambda s, d: r6(ev.calibration_table(fx.scored(s, d), EDGES)), with_views("scored") + f"SELECT CAST({_band('>=')} AS BIGINT) AS band, count(*) AS n, round(avg(p), 6) AS stated, round(avg(CAST(label AS DOUBLE)), 6) AS observed FROM scored GROUP BY 1")
register("m14_by_year", lambda s, d: r6(ev.auc(fx.scored(s, d).withColumn("year", F.year("trade_date").cast("long")), ["year"])), with_views("scored") + ", sy AS (SELECT *, year(trade_date) AS year FROM scored) SELECT year, round(auc, 6) AS auc FROM (" + RANKSUM.format(by="year, ", part="year", src="sy", group="GROUP BY year") + ") z")
register("m15_wilson", lambda s, d: fx.scored(s, d).groupBy("trade_date").agg(F.count("*").alias("n"), F.count(F.when(F.col("label"), 1)).alias("h")).select("trade_date", F.round(ev.wilson_lower(F.col("h"), F.col("n")), 6).alias("lower")), with_views("scored") + f"SELECT trade_date, round({wil('count(*) FILTER (WHERE label)', 'count(*)')}, 6) AS lower FROM scored GROUP BY 1")
CURVE = ", g AS (SELECT cutoff, n, h, h / n AS pr, " + wil("h", "n") + " AS lo FROM (SELECT p AS cutoff, sum(count(*)) OVER (ORDER BY p DESC) AS n, sum(count(*) FILTER (WHERE label)) OVER (ORDER BY p DESC) AS h FROM scored GROUP BY p) x)\n"
register("m16_precision_gate", lambda s, d: r6(ev.pick_gate(ev.cumulative_gate(fx.scored(s, d)), 0.3, 30, 0.2)), with_views("scored") + CURVE + "SELECT min(CASE WHEN pr >= 0.3 AND n >= 30 AND lo >= 0.2 THEN cutoff END) AS cutoff, round(max(CASE WHEN n >= 30 THEN pr END), 6) AS best_precision, CASE WHEN min(CASE WHEN pr >= 0.3 AND n >= 30 AND lo >= 0.2 THEN cutoff END) IS NOT NULL THEN 'LIVE' ELSE 'OFF' END AS status FROM g")
cuts = lambda s, n=10: s.range(1, n).select((F.col("id") / n).alias("cutoff"))
CAPPED = ", t AS (SELECT c / 10.0 AS cutoff, trade_date, label, row_id, p FROM range(1, 10) g(c) JOIN scored ON p >= c / 10.0 QUALIFY row_number() OVER (PARTITION BY c, trade_date ORDER BY p DESC, row_id) <= 3)\n"
register("m16_capped_gate", lambda s, d: r6(ev.pick_gate(ev.precision_curve(fx.scored(s, d), cuts(s), 3), 0.2, 30, 0.1)), with_views("scored") + CAPPED + ", g AS (SELECT cutoff, count(*) AS n, count(*) FILTER (WHERE label) / count(*) AS pr, " + wil("count(*) FILTER (WHERE label)", "count(*)") + " AS lo FROM t GROUP BY 1) SELECT min(CASE WHEN pr >= 0.2 AND n >= 30 AND lo >= 0.1 THEN cutoff END) AS cutoff, round(max(CASE WHEN n >= 30 THEN pr END), 6) AS best_precision, CASE WHEN min(CASE WHEN pr >= 0.2 AND n >= 30 AND lo >= 0.1 THEN cutoff END) IS NOT NULL THEN 'LIVE' ELSE 'OFF' END AS status FROM g")
register("m17_precision_curve", lambda s, d: r6(ev.precision_curve(fx.scored(s, d), cuts(s))), with_views("scored") + "SELECT cutoff, count(*) AS n, count(*) FILTER (WHERE label) AS hits, count(DISTINCT trade_date) AS weeks, round(count(*) FILTER (WHERE label) / count(*), 6) AS precision, round(" + wil("count(*) FILTER (WHERE label)", "count(*)") + ", 6) AS lower FROM (SELECT c / 10.0 AS cutoff, s.* FROM range(1, 10) g(c) JOIN scored s ON p >= c / 10.0) x GROUP BY 1")
warn = lambda s, d: fx.scored(s, d).groupBy("company_id", "trade_date").agg(F.max("p").alias("p"), F.max_by("label", F.struct("p", "row_id")).alias("label"))
register("m18_dedupe_warnings", lambda s, d: ev.dedupe_warnings(warn(s, d), 28), with_views("scored").replace("WITH", "WITH RECURSIVE", 1) + """, w AS (SELECT company_id, trade_date, arg_max(label, (p, row_id)) AS label FROM scored GROUP BY 1, 2), k AS (SELECT company_id, min(trade_date) AS trade_date FROM w GROUP BY 1 UNION ALL SELECT k.company_id, (SELECT min(trade_date) FROM w WHERE w.company_id = k.company_id AND w.trade_date >= k.trade_date + 28) FROM k WHERE k.trade_date IS NOT NULL)
SELECT w.company_id, w.trade_date, w.label FROM k JOIN w ON w.company_id = k.company_id AND w.trade_date = k.trade_date""")
