"""Queries of validation, flags, scores, coverage and health."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..lake import stored
from ..operators import decisions as dc
from ..operators import prices as pr
from ..operators import quality as ql
from . import fixtures as fx
from .domain import CONT, PARSE, UNI, cont, dated_actions, universe
from .sqltext import with_views
from .windows import LATEST

t = fx.table
KEYS = ["company_id", "trade_date"]


# one price file a day; every seventh line of an order is filed a day late, discounts of 0.05 lack a price
def price_files(s, d):
    late = F.when(F.col("l_linenumber") == 7, F.date_add("trade_date", 1)).otherwise(F.col("trade_date"))
    return fx.px(s, d).select("company_id", "trade_date", "l_orderkey", late.alias("file_date"), F.when(F.col("l_discount") != 0.05, F.col("px")).alias("px"), F.col("l_returnflag").alias("segment"))


PRICE_FILES = with_views("px") + """, x AS (
  SELECT company_id, trade_date, l_orderkey, CASE WHEN l_linenumber = 7 THEN trade_date + 1 ELSE trade_date END AS file_date,
         CASE WHEN l_discount <> 0.05 THEN px END AS px, l_returnflag AS segment
  FROM px)
"""
register("c01_validate_prices", lambda s, d: ql.validate_prices(price_files(s, d), 20, ["px"], ["company_id", "trade_date", "l_orderkey"], {"segment": ("A", "N")}), PRICE_FILES + """SELECT * FROM (
  SELECT file_date, 'date_mismatch' AS rule, 'BLOCK' AS severity, count(*) FILTER (WHERE trade_date <> file_date) AS n FROM x GROUP BY 1
  UNION ALL SELECT file_date, 'required_nulls', 'BLOCK', count(*) FILTER (WHERE px IS NULL) FROM x GROUP BY 1
  UNION ALL SELECT file_date, 'unexpected_segment', 'WARN', count(*) FILTER (WHERE segment NOT IN ('A', 'N')) FROM x GROUP BY 1
  UNION ALL SELECT file_date, 'too_few_rows', 'BLOCK', CASE WHEN count(*) < 20 THEN count(*) ELSE 0 END FROM x GROUP BY 1
  UNION ALL SELECT file_date, 'duplicate_keys', 'BLOCK', count(*) FROM (SELECT file_date FROM x GROUP BY file_date, company_id, trade_date, l_orderkey HAVING count(*) > 1) y GROUP BY 1
) z WHERE n > 0""")


def deliveries(s, d):
    traded = F.col("l_quantity") - 2
    delivered = F.when(F.col("l_tax") != 0.03, F.col("l_quantity") * (1 + F.col("l_tax")))
    return t(s, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("trade_date"), "l_suppkey", delivered.alias("deliverable_qty"), traded.alias("qty_traded"))


register("c02_validate_delivery", lambda s, d: ql.validate_delivery(deliveries(s, d), ["deliverable_qty"], ["l_suppkey"]), """WITH x AS (
  SELECT CAST(l_shipdate AS DATE) AS trade_date, l_suppkey, CASE WHEN l_tax <> 0.03 THEN l_quantity * (1 + l_tax) END AS dq, l_quantity - 2 AS qt FROM lineitem)
SELECT * FROM (
  SELECT trade_date, 'required_nulls' AS rule, 'BLOCK' AS severity, count(*) FILTER (WHERE dq IS NULL) AS n FROM x GROUP BY 1
  UNION ALL SELECT trade_date, 'negative', 'BLOCK', count(*) FILTER (WHERE qt < 0 OR dq < 0) FROM x GROUP BY 1
  UNION ALL SELECT trade_date, 'deliverable_over_traded', 'WARN', count(*) FILTER (WHERE dq > qt) FROM x GROUP BY 1
  UNION ALL SELECT trade_date, 'duplicate_keys', 'BLOCK', count(*) FROM (SELECT trade_date FROM x GROUP BY trade_date, l_suppkey HAVING count(*) > 1) y GROUP BY 1
) z WHERE n > 0""")

CORE = ["clerk 1", "clerk 7", "clerk none"]
register("c03_validate_index", lambda s, d: ql.validate_index(t(s, d, "orders").select(F.concat(F.lit("Clerk "), F.pmod("o_orderkey", F.lit(40000)).cast("string")).alias("index_name"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("close")), CORE), """WITH x AS (
  SELECT lower(concat('Clerk ', CAST(o_orderkey % 40000 AS VARCHAR))) AS name, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'P') AS nulls FROM orders GROUP BY 1)
SELECT * FROM (
  SELECT 'core_repeated' AS rule, 'BLOCK' AS severity, count(*) FILTER (WHERE name IN ('clerk 1', 'clerk 7', 'clerk none') AND n > 1) AS n FROM x
  UNION ALL SELECT 'repeated', 'WARN', count(*) FILTER (WHERE name NOT IN ('clerk 1', 'clerk 7', 'clerk none') AND n > 1) FROM x
  UNION ALL SELECT 'null_close', 'WARN', count(*) FILTER (WHERE nulls > 0) FROM x
  UNION ALL SELECT 'core_missing', 'BLOCK', 3 - count(*) FILTER (WHERE name IN ('clerk 1', 'clerk 7', 'clerk none')) FROM x
) y WHERE n > 0""")

# a month's file also holds the first days of the next one
register("c04_validate_actions", lambda s, d: ql.validate_actions(dated_actions(s, d).select(F.when(F.col("p_partkey") % 11 != 0, F.col("company_id")).alias("company_id"), "ex_date", F.date_format(F.date_sub("ex_date", 3), "yyyy-MM").alias("month"))), with_views("action_text") + """, x AS (
  SELECT CASE WHEN p_partkey % 11 <> 0 THEN company_id END AS company_id, DATE '1996-01-01' + CAST(p_partkey % 900 AS INT) AS ex_date FROM action_text),
y AS (SELECT *, strftime(ex_date - 3, '%Y-%m') AS month FROM x)
SELECT * FROM (
  SELECT month, 'null_key' AS rule, 'BLOCK' AS severity, count(*) FILTER (WHERE company_id IS NULL) AS n FROM y GROUP BY 1
  UNION ALL SELECT month, 'outside_month', 'WARN', count(*) FILTER (WHERE strftime(ex_date, '%Y-%m') <> month) FROM y GROUP BY 1
) z WHERE n > 0""")
register("c04_validate_reference", lambda s, d: ql.validate_reference(fx.symbol_changes(s, d).withColumn("new_symbol", F.when(~F.col("new_symbol").endswith("00"), F.col("new_symbol"))), ["old_symbol", "new_symbol"], F.lit("2020-06-30").cast("date")), with_views("symbol_changes") + """SELECT * FROM (
  SELECT 'null_key' AS rule, 'BLOCK' AS severity, count(*) FILTER (WHERE new_symbol LIKE '%00') AS n FROM symbol_changes
  UNION ALL SELECT 'future_date', 'WARN', count(*) FILTER (WHERE change_date > DATE '2020-06-30') FROM symbol_changes
) z WHERE n > 0""")
register("c04_validate_results", lambda s, d: ql.validate_results(fx.filings(s, d).select("period_to", F.when(F.col("filing_id") % 17 != 0, F.col("company_id")).alias("company_id"), F.when(F.hour("published_at") != 3, F.col("published_at")).alias("published_at")), ["company_id"], by=("period_to",)), with_views("filings") + """, x AS (
  SELECT period_to, CASE WHEN filing_id % 17 <> 0 THEN company_id END AS company_id, CASE WHEN hour(published_at) <> 3 THEN published_at END AS at_ FROM filings)
SELECT * FROM (
  SELECT period_to, 'null_key' AS rule, 'BLOCK' AS severity, count(*) FILTER (WHERE company_id IS NULL) AS n FROM x GROUP BY 1
  UNION ALL SELECT period_to, 'missing_times', 'WARN', CASE WHEN count(*) FILTER (WHERE at_ IS NULL) > 0.05 * count(*) THEN count(*) FILTER (WHERE at_ IS NULL) ELSE 0 END FROM x GROUP BY 1
) z WHERE n > 0""")

# flags: prices are held against split factors alone, so that real moves stand out
ADJUSTED = """, cum AS (
  SELECT company_id, ex_date, exp(sum(ln(price_factor)) OVER (PARTITION BY company_id ORDER BY ex_date DESC)) AS f FROM factors),
adj AS (
  SELECT b.*, round(b.close * coalesce(c.f, 1), 8) AS adj_close FROM bars b ASOF LEFT JOIN cum c ON b.company_id = c.company_id AND b.trade_date < c.ex_date)
"""
FLAGS = ADJUSTED + """, fd AS (SELECT company_id, min(trade_date) AS first_day FROM bars GROUP BY 1),
g AS (
  SELECT company_id, trade_date, close, lag(trade_date) OVER w AS prev_date, lag(close) OVER w AS prior, lag(adj_close) OVER w AS prev_adj,
         adj_close / lag(adj_close) OVER w - 1 AS move, trade_date - lag(trade_date) OVER w AS gap
  FROM adj WINDOW w AS (PARTITION BY company_id ORDER BY trade_date)),
q AS (
  SELECT *, close / prior AS raw FROM g WHERE prev_date IS NOT NULL
   AND NOT EXISTS (SELECT 1 FROM breaks k WHERE k.company_id = g.company_id AND k.break_date > prev_date AND k.break_date <= trade_date)
   AND NOT EXISTS (SELECT 1 FROM factors k WHERE k.company_id = g.company_id AND k.ex_date > prev_date AND k.ex_date <= trade_date)),
big AS (
  SELECT *, raw <= 0.55 AND prior >= 10 AND gap <= 10
         AND list_min([abs(raw - 0.5) / 0.5, abs(raw - 1/3) / (1/3), abs(raw - 0.25) / 0.25, abs(raw - 0.2) / 0.2, abs(raw - 0.1) / 0.1, abs(raw - 0.4) / 0.4]) <= 0.03 AS split_like
  FROM q WHERE abs(move) > 0.2 + 0.1 / prev_adj),
un AS (SELECT o.company_id, o.ex_date, p.kind FROM once o JOIN parsed p USING (p_partkey) WHERE p.status = 'unparsed'),
fl AS (
  SELECT company_id, trade_date AS from_date, trade_date AS to_date, 'ohlc_integrity' AS "check", 'BLOCK' AS severity FROM bars
  WHERE least(open, high, low, close) <= 0 OR high < low - 1e-6 OR greatest(open, close) > high + 1e-6 OR least(open, close) < low - 1e-6 OR volume < 0
  UNION ALL SELECT company_id, first_day, trade_date - 1, 'possible_missing_action', 'BLOCK' FROM big JOIN fd USING (company_id) WHERE split_like
  UNION ALL SELECT company_id, trade_date, trade_date, 'large_move', 'WARN' FROM big WHERE NOT split_like
  UNION ALL SELECT company_id, prev_date + 1, trade_date - 1, 'trading_gap', 'WARN' FROM q WHERE gap > 15
  UNION ALL SELECT company_id, first_day, ex_date - 1, 'unreconciled_adjustment', 'BLOCK' FROM cont JOIN fd USING (company_id) WHERE NOT passed
  UNION ALL SELECT company_id, coalesce(first_day, ex_date), ex_date - 1, 'unparsed_action', 'BLOCK' FROM un LEFT JOIN fd USING (company_id) WHERE kind <> 'dividend'
  UNION ALL SELECT company_id, ex_date, ex_date, 'unparsed_dividend', 'WARN' FROM un WHERE kind = 'dividend')
"""
ONCE = """, once AS (
  SELECT a.*, DATE '1996-01-01' + CAST(p_partkey % 900 AS INT) AS ex_date FROM action_text a
  QUALIFY row_number() OVER (PARTITION BY company_id, DATE '1996-01-01' + CAST(p_partkey % 900 AS INT), subject ORDER BY p_partkey) = 1)
"""


def events(s, d):
    return pr.build_events(dated_actions(s, d), fx.breaks(s, d).select("company_id").distinct())


def adjusted(s, d):
    return pr.adjusted_prices(fx.bars(s, d), fx.factors(s, d)).withColumn("adj_close", F.round("adj_close", 8))


def price_flags(s, d):
    bars, factors, breaks = stored(fx.bars(s, d)), stored(fx.factors(s, d)), stored(fx.breaks(s, d))  # each is read several times
    adj = pr.adjusted_prices(bars, factors).withColumn("adj_close", F.round("adj_close", 8))
    events_ = pr.build_events(dated_actions(s, d), breaks.select("company_id").distinct())
    return ql.price_flags(bars, adj, breaks, factors, pr.continuity_check(bars, factors, breaks), events_)


register("c18_price_flags", lambda s, d: price_flags(s, d).select("company_id", "from_date", "to_date", "check", "severity"), PARSE.replace(with_views("action_text"), with_views("action_text", "factors", "breaks")).rstrip() + ONCE.rstrip() + CONT[len(with_views("factors", "breaks")):].rstrip() + FLAGS.rstrip() + "\nSELECT company_id, from_date, to_date, \"check\", severity FROM fl WHERE from_date <= to_date")

# the score: two of the three core indices always close, the third on days with a spread; months without a factor are not loaded
INDEX = lambda s, d: fx.market(s, d).select("trade_date", F.when(F.col("vix").isNotNull(), 3).otherwise(2).alias("core"))
MONTHS = lambda s, d: dated_actions(s, d).where(F.month("ex_date") != 5).select(F.date_format("ex_date", "yyyy-MM").alias("month")).distinct()


def score(s, d):
    return ql.quality_score(universe(s, d), fx.bars(s, d), fx.flags(s, d), INDEX(s, d), MONTHS(s, d))


SCORE = UNI.replace(with_views("bars"), with_views("bars", "market", "flags", "action_text")).rstrip() + """, ss AS (SELECT DISTINCT trade_date, strftime(trade_date, '%Y-%m') AS month FROM bars),
mem AS (SELECT trade_date, company_id FROM ss JOIN uni USING (month)),
am AS (SELECT DISTINCT strftime(DATE '1996-01-01' + CAST(p_partkey % 900 AS INT), '%Y-%m') AS month FROM action_text WHERE month(DATE '1996-01-01' + CAST(p_partkey % 900 AS INT)) <> 5),
dy AS (
  SELECT m.trade_date, count(*) AS members, count(b.company_id) AS priced,
         count(*) FILTER (WHERE EXISTS (SELECT 1 FROM flags f WHERE f.severity = 'BLOCK' AND f.company_id = m.company_id AND m.trade_date BETWEEN f.from_date AND f.to_date)) AS blocked,
         count(b.delivery_pct) AS delivered
  FROM mem m LEFT JOIN bars b ON b.trade_date = m.trade_date AND b.company_id = m.company_id GROUP BY 1),
ik AS (SELECT trade_date, CASE WHEN vix IS NOT NULL THEN 3 ELSE 2 END AS core FROM market),
sc AS (
  SELECT d.trade_date, members, priced, blocked, round(35 * least(greatest((priced / members - 0.95) / (1 - 0.95), 0), 1) + 25 * least(greatest((1 - blocked / members - 0.90) / (1 - 0.90), 0), 1)
         + 15 * CASE WHEN am.month IS NOT NULL THEN 1 ELSE 0 END
         + 15 * least(greatest((CASE WHEN priced = 0 THEN 0 ELSE delivered / priced END - 0.90) / (1 - 0.90), 0), 1) + 10 * coalesce(k.core / 3, 0), 2) AS score
  FROM dy d LEFT JOIN ik k ON k.trade_date = d.trade_date LEFT JOIN am ON am.month = strftime(d.trade_date, '%Y-%m'))
"""
register("c19_quality_score", score, SCORE + "SELECT * FROM sc")


def r6(df):
    return df.select(*[F.round(n, 6).alias(n) if k == "double" else F.col(n) for n, k in df.dtypes])


register("c20_quality_gate", lambda s, d: r6(ql.quality_gate(score(s, d), cont(s, d), fx.factors(s, d).where("price_factor = 0.5").select("company_id", "ex_date"))), SCORE.replace(with_views("bars", "market", "flags", "action_text"), with_views("bars", "market", "flags", "action_text", "breaks"), 1).rstrip() + CONT[len(with_views("factors", "breaks")):].rstrip() + """, q AS (
  SELECT (SELECT avg(CAST(passed AS DOUBLE)) FROM cont) AS continuous,
         (SELECT coalesce(bool_and(coalesce(c.passed, false)), true) FROM factors f LEFT JOIN cont c ON c.company_id = f.company_id AND c.ex_date = f.ex_date WHERE f.price_factor = 0.5) AS known_ok,
         (SELECT avg(CAST(score >= 95 AS DOUBLE)) FROM sc) AS good_days, (SELECT max_by(score, trade_date) FROM sc) AS latest)
SELECT round(continuous, 6) AS continuous, known_ok, round(good_days, 6) AS good_days, latest, continuous >= 0.98 AND known_ok AND good_days >= 0.95 AND latest >= 95 AS passed FROM q""")

# coverage
register("c21_coverage", lambda s, d: ql.coverage(fx.attempts(s, d)), LATEST + """SELECT source_id, year(partition_key) AS year, count(*) FILTER (WHERE status = 'success') AS loaded, count(*) FILTER (WHERE status = 'not_available') AS no_file,
  count(*) FILTER (WHERE status = 'failed') AS failed, count(*) AS partitions, round(100 * count(*) FILTER (WHERE status = 'success') / count(*), 2) AS loaded_pct
FROM latest GROUP BY 1, 2""")
COMPLETE = SCORE.rstrip() + """, cp AS (
  SELECT d.trade_date, members, priced, round(100 * priced / members, 2) AS priced_pct, round(100 * delivered / nullif(priced, 0), 2) AS delivered_pct, CAST(coalesce(core, 0) AS BIGINT) AS core
  FROM dy d LEFT JOIN ik USING (trade_date))
"""
complete = lambda s, d: ql.completeness(universe(s, d), fx.bars(s, d), INDEX(s, d))
register("c21_completeness", complete, COMPLETE + "SELECT * FROM cp")
register("c21_coverage_gate", lambda s, d: ql.coverage_gate(complete(s, d), fx.attempts(s, d), ["login", "purchase", "none"]), COMPLETE.replace(with_views("bars", "market", "flags", "action_text"), with_views("bars", "market", "flags", "action_text", "attempts"), 1) + """SELECT min(priced_pct) AS worst_pct, count(*) FILTER (WHERE priced_pct < 98) AS sessions_below,
  3 - (SELECT count(DISTINCT source_id) FROM attempts WHERE status = 'success' AND source_id IN ('login', 'purchase', 'none')) AS sources_missing,
  count(*) FILTER (WHERE priced_pct < 98) = 0 AND 3 = (SELECT count(DISTINCT source_id) FROM attempts WHERE status = 'success' AND source_id IN ('login', 'purchase', 'none')) AS passed
FROM cp""")
register("c21_cross_check", lambda s, d: ql.cross_check(fx.bars(s, d), fx.bars(s, d).where("volume >= 30").withColumn("close", F.when(F.dayofmonth("trade_date") == 9, F.col("open")).otherwise(F.col("close"))), KEYS, "close"), with_views("bars") + """SELECT count(*) FILTER (WHERE volume >= 30) AS common, count(*) FILTER (WHERE volume < 30) AS only_a, CAST(0 AS BIGINT) AS only_b,
  round(avg(CASE WHEN volume >= 30 THEN CAST(day(trade_date) <> 9 OR abs(close - open) <= 0.005 AS DOUBLE) END), 6) AS agree
FROM bars""")
register("c21_calendar_years", lambda s, d: ql.calendar_years(t(s, d, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct().withColumn("status", F.when(F.weekday("day") >= 5, "weekend").when(F.dayofmonth("day") == 1, "holiday").otherwise("session"))), """WITH x AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT year(day) AS year, count(*) FILTER (WHERE isodow(day) < 6 AND day(day) <> 1) AS sessions, count(*) FILTER (WHERE isodow(day) < 6 AND day(day) = 1) AS holidays,
  count(*) FILTER (WHERE isodow(day) >= 6) AS weekends, CAST(0 AS BIGINT) AS expected
FROM x GROUP BY 1""")


def quarantine(s, d):
    """Failed attempts, of which the users below a thousand's half have been dealt with."""
    a = t(s, d, "events").where("user_id % 4 = 3")
    return a.select(F.col("event_type").alias("source_id"), F.when(F.col("value") > 50, "BLOCK").otherwise("WARN").alias("severity"), F.when(F.col("user_id") % 3 == 0, F.col("ts")).alias("resolved_at"))


QUARANTINE = "SELECT event_type AS source_id, CASE WHEN value > 50 THEN 'BLOCK' ELSE 'WARN' END AS severity, CASE WHEN user_id % 3 = 0 THEN ts END AS resolved_at FROM events WHERE user_id % 4 = 3"
register("c21_quarantine", lambda s, d: ql.quarantine_summary(quarantine(s, d)), f"SELECT source_id, severity, count(*) FILTER (WHERE resolved_at IS NULL) AS open, count(resolved_at) AS resolved FROM ({QUARANTINE}) q GROUP BY 1, 2")
register("c57_audit_health", lambda s, d: r6(dc.audit_health(score(s, d), fx.attempts(s, d), ql.latest_attempts(fx.attempts(s, d)), quarantine(s, d))), SCORE.replace(with_views("bars", "market", "flags", "action_text"), with_views("bars", "market", "flags", "action_text").rstrip() + ", " + LATEST.strip().removeprefix("WITH "), 1) + f""", qu AS ({QUARANTINE}),
fz AS (SELECT count(*) FILTER (WHERE status = 'failed') AS failed, count(*) AS runs FROM attempts), uz AS (SELECT count(*) FILTER (WHERE status = 'failed') AS unresolved FROM latest)
SELECT (SELECT min(score) FROM sc) AS worst, (SELECT round(avg(score), 4) FROM sc) AS mean, unresolved, runs, failed - unresolved AS retried,
  (SELECT count(*) FROM qu WHERE resolved_at IS NULL AND severity = 'BLOCK') AS open_block, (SELECT count(*) FROM qu WHERE resolved_at IS NULL AND severity = 'WARN') AS open_warn
FROM fz, uz""")
