"""Queries of issued signals, gates, audits, admission, imports and fundamentals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..operators import decisions as dc
from ..operators import evaluate as ev
from ..operators import prices as pr
from . import fixtures as fx
from .domain import EDGE, MONEY, RANKSUM, money_results, opportunities, warn, wil
from .sqltext import with_views

t = fx.table
KEYS = ["company_id", "trade_date"]


def r6(df):
    return df.select(*[F.round(n, 6).alias(n) if k == "double" else F.col(n) for n, k in df.dtypes])


# gates
JUDGED = with_views("scored") + f""", r AS ({MONEY}), b AS (SELECT *, xirr > 0.09 AS beats FROM r),
j AS (
  SELECT cutoff, xirr, xirr_stress, beats, beats AND xirr_stress > 0.09 AND max_drawdown >= -0.3 AND won / years >= 0.2
         AND (coalesce(lag(beats) OVER (ORDER BY cutoff), false) OR coalesce(lead(beats) OVER (ORDER BY cutoff), false)) AS ok
  FROM b)
"""
judged = lambda s, d: dc.judge_money(money_results(s, d), 0.09, -0.2, share=0.2)
register("c44_judge_money", lambda s, d: r6(judged(s, d).select("cutoff", "xirr", "beats", "ok")), JUDGED + "SELECT cutoff, round(xirr, 6) AS xirr, beats, ok FROM j")
register("c44_money_gate", lambda s, d: r6(dc.money_gate(judged(s, d))), JUDGED + """SELECT CASE WHEN ok THEN 'LIVE' ELSE 'OFF' END AS status, CASE WHEN ok THEN cutoff END AS cutoff, cutoff AS closest, round(xirr, 6) AS xirr, round(xirr_stress, 6) AS xirr_stress
FROM j ORDER BY ok DESC, xirr_stress DESC, cutoff LIMIT 1""")

CUTS = lambda s: s.range(0, 27).select(F.round(0.30 + 0.025 * F.col("id"), 3).alias("cutoff"))
WARNED = with_views("scored").replace("WITH", "WITH RECURSIVE", 1) + """, w AS (SELECT company_id, trade_date, max(p) AS p, arg_max(label, (p, row_id)) AS label FROM scored GROUP BY 1, 2),
c AS (SELECT round(0.30 + 0.025 * i, 3) AS cutoff FROM range(0, 27) g(i)),
v AS (SELECT cutoff, company_id, trade_date, label FROM c JOIN w ON p >= cutoff),
k AS (
  SELECT cutoff, company_id, min(trade_date) AS trade_date FROM v GROUP BY 1, 2
  UNION ALL
  SELECT k.cutoff, k.company_id, (SELECT min(trade_date) FROM v WHERE v.cutoff = k.cutoff AND v.company_id = k.company_id AND v.trade_date >= k.trade_date + 28)
  FROM k WHERE k.trade_date IS NOT NULL),
z AS (SELECT v.* FROM k JOIN v ON v.cutoff = k.cutoff AND v.company_id = k.company_id AND v.trade_date = k.trade_date),
ye AS (SELECT cutoff, count(*) AS years, count(*) FILTER (WHERE pr >= 0.2) AS years_ok FROM (SELECT cutoff, avg(CAST(label AS DOUBLE)) AS pr FROM z GROUP BY cutoff, year(trade_date) HAVING count(*) >= 5) y GROUP BY 1),
js AS (
  SELECT cutoff, count(*) AS n, count(*) FILTER (WHERE label) AS hits, coalesce(max(years), 0) AS years, coalesce(max(years_ok), 0) AS years_ok,
         count(*) FILTER (WHERE label) / count(*) AS precision, """ + wil("count(*) FILTER (WHERE label)", "count(*)") + """ AS lower
  FROM z LEFT JOIN ye USING (cutoff) GROUP BY 1),
jo AS (SELECT *, n >= 30 AND precision >= 0.3 AND lower >= 0.2 AND years > 0 AND years_ok >= 0.6 * years AS ok FROM js)
"""
safety = lambda s, d: ev.judge_safety(warn(s, d), CUTS(s), bar=0.3, lower=0.2)
register("m19_judge_safety", lambda s, d: r6(safety(s, d)), WARNED + "SELECT cutoff, n, hits, years, years_ok, round(precision, 6) AS precision, round(lower, 6) AS lower, ok FROM jo")
register("m19_safety_gate", lambda s, d: r6(ev.safety_gate(safety(s, d))), WARNED + """, u AS (SELECT * FROM jo WHERE cutoff < coalesce((SELECT min(cutoff) FROM jo WHERE n < 30), 9))
SELECT CASE WHEN min(CASE WHEN ok THEN cutoff END) IS NOT NULL THEN 'LIVE' ELSE 'OFF' END AS status, min(CASE WHEN ok THEN cutoff END) AS cutoff,
  arg_max(cutoff, (precision, -cutoff)) AS best_cutoff, round(max(precision), 6) AS best_precision FROM u""")


# stored predictions of two signals: re-evaluated with a weekly cap, and at a bar
def stored(s, d):
    return fx.scored(s, d).withColumn("signal", F.when(F.col("row_id") % 2 == 0, "A").otherwise("C"))


def m22(s, d):
    parts = []
    for signal, cap in (("A", 3), ("C", None)):
        gate = ev.pick_gate(ev.precision_curve(stored(s, d).where(F.col("signal") == signal), s.range(1, 10).select((F.col("id") / 10).alias("cutoff")), cap), 0.2, 30, 0.1)
        parts.append(gate.withColumn("signal", F.lit(signal)))
    return r6(parts[0].unionByName(parts[1]))


STORED = with_views("scored") + """, st AS (SELECT *, CASE WHEN row_id % 2 = 0 THEN 'A' ELSE 'C' END AS signal FROM scored)"""
register("m22_reevaluate_gate", m22, STORED + """, x AS (
  SELECT c / 10.0 AS cutoff, st.*, row_number() OVER (PARTITION BY signal, c, trade_date ORDER BY p DESC, row_id) AS rn FROM range(1, 10) g(c) JOIN st ON p >= c / 10.0),
g AS (
  SELECT signal, cutoff, count(*) AS n, count(*) FILTER (WHERE label) / count(*) AS pr, """ + wil("count(*) FILTER (WHERE label)", "count(*)") + """ AS lo
  FROM x WHERE signal = 'C' OR rn <= 3 GROUP BY 1, 2)
SELECT signal, min(CASE WHEN pr >= 0.2 AND n >= 30 AND lo >= 0.1 THEN cutoff END) AS cutoff, round(max(CASE WHEN n >= 30 THEN pr END), 6) AS best_precision,
  CASE WHEN min(CASE WHEN pr >= 0.2 AND n >= 30 AND lo >= 0.1 THEN cutoff END) IS NOT NULL THEN 'LIVE' ELSE 'OFF' END AS status
FROM g GROUP BY 1""")
register("m22_precision_at_bar", lambda s, d: r6(ev.precision_curve(fx.scored(s, d), s.range(1).select(F.lit(0.65).alias("cutoff")))), with_views("scored") + "SELECT CAST(0.65 AS DOUBLE) AS cutoff, count(*) AS n, count(*) FILTER (WHERE label) AS hits, count(DISTINCT trade_date) AS weeks, round(count(*) FILTER (WHERE label) / count(*), 6) AS precision, round(" + wil("count(*) FILTER (WHERE label)", "count(*)") + ", 6) AS lower FROM scored WHERE p >= 0.65")
register("m23_model_comparison", lambda s, d: r6(ev.compare_scores(fx.scored(s, d), ["p", "expected_gain"], 5, 0.2, 30, 0.1)), with_views("scored") + """, m AS (SELECT 'p' AS model, row_id, trade_date, label, p FROM scored UNION ALL SELECT 'expected_gain', row_id, trade_date, label, expected_gain FROM scored),
a AS (""" + RANKSUM.format(by="model, ", part="model", src="m", group="GROUP BY model") + """),
t5 AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY model, trade_date ORDER BY p DESC, row_id) <= 5),
k AS (SELECT model, p, sum(count(*)) OVER w AS n, sum(count(*) FILTER (WHERE label)) OVER w AS h FROM t5 GROUP BY model, p WINDOW w AS (PARTITION BY model ORDER BY p DESC)),
g AS (SELECT model, max(CASE WHEN n >= 30 THEN h / n END) AS best, bool_or(n >= 30 AND h / n >= 0.2 AND """ + wil("h", "n") + """ >= 0.1) AS live FROM k GROUP BY 1)
SELECT model, round(auc, 6) AS auc, round((SELECT avg(CAST(label AS DOUBLE)) FROM t5 WHERE t5.model = a.model), 6) AS top_k_precision, round(best, 6) AS best_precision, CASE WHEN live THEN 'LIVE' ELSE 'OFF' END AS gate
FROM a JOIN g USING (model)""")

# plans and what became of them
chosen = lambda s, d: fx.scored(s, d).where("p >= 0.99")
register("c50_watch_queue", lambda s, d: dc.watch_queue(fx.scored(s, d), fx.scored(s, d).where("p >= 0.9")).select("trade_date", "row_id", "rank"), with_views("scored") + "SELECT trade_date, row_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY p DESC, row_id) AS rank FROM scored WHERE p < 0.9) x WHERE rank <= 15")
register("c50_closest_candidate", lambda s, d: dc.closest_candidate(fx.scored(s, d), chosen(s, d)), with_views("scored") + "SELECT trade_date, arg_max(row_id, (p, -row_id)) AS row_id, max(p) AS p FROM scored WHERE trade_date NOT IN (SELECT trade_date FROM scored WHERE p >= 0.99) GROUP BY 1")


def plans(s, d):
    """A plan a week: opportunities from 0.9 on, exits up to 0.1, those of every third row by rule and so without a probability."""
    item = F.struct("row_id", F.when((F.col("p") >= 0.9) | (F.col("row_id") % 3 != 0), F.col("p")).alias("p"))
    per = fx.scored(s, d).groupBy("trade_date").agg(F.collect_list(F.when(F.col("p") >= 0.9, item)).alias("opportunities"), F.collect_list(F.when(F.col("p") <= 0.1, item)).alias("exits"))
    return per.select(F.datediff("trade_date", F.lit("1970-01-01").cast("date")).cast("long").alias("plan_id"), "trade_date", F.to_json(F.struct("opportunities", "exits")).alias("payload"))


ISSUED = with_views("scored") + """, iss AS (
  SELECT CAST(trade_date - DATE '1970-01-01' AS BIGINT) AS plan_id, trade_date, CASE WHEN p >= 0.9 THEN 'A' ELSE 'C' END AS signal, row_id, p
  FROM scored WHERE p >= 0.9 OR (p <= 0.1 AND row_id % 3 <> 0))
"""
register("c53_issued_signals", lambda s, d: dc.issued_signals(plans(s, d)), ISSUED + "SELECT * FROM iss")


def truths(s, d):
    x = fx.scored(s, d)
    return x.select("row_id", F.lit("A").alias("signal"), "label").unionByName(x.select("row_id", F.lit("C").alias("signal"), (F.col("expected_gain") < 0.2).alias("label")))


register("c55_missed_events", lambda s, d: dc.missed_events(dc.issued_signals(plans(s, d)), truths(s, d), ["row_id"]), ISSUED + """, ev AS (SELECT row_id, 'A' AS signal FROM scored WHERE label UNION ALL SELECT row_id, 'C' FROM scored WHERE expected_gain < 0.2)
SELECT signal, count(*) AS events, count(i.row_id) AS flagged, count(*) - count(i.row_id) AS missed FROM ev e LEFT JOIN iss i USING (row_id, signal) GROUP BY 1""")
BANDS = (0.05, 0.1, 0.2, 0.3, 0.5)
_over = " + ".join(f"CAST(p > {e} AS INT)" for e in BANDS)


def live_calibration(s, d):
    both = stored(s, d).select("signal", "p", "label").unionByName(stored(s, d).select(F.lit("all").alias("signal"), "p", "label"))
    return r6(ev.calibration_table(both, BANDS, left_closed=False, by=("signal",)))


register("c56_live_calibration", live_calibration, STORED + f""", b AS (SELECT signal, p, label FROM st UNION ALL SELECT 'all', p, label FROM st)
SELECT signal, CAST({_over} AS BIGINT) AS band, count(*) AS n, round(avg(p), 6) AS stated, round(avg(CAST(label AS DOUBLE)), 6) AS observed FROM b GROUP BY 1, 2""")
alerts_of = lambda events: events.select(F.col("event_id").alias("alert_id"), "ts", F.col("event_type").alias("kind"), F.concat_ws("-", "event_type", F.col("user_id").cast("string"), F.col("ts").cast("date").cast("string")).alias("dedupe_key"))
alerts = lambda s, d: alerts_of(t(s, d, "events"))
register("c61_alert_admission", lambda s, d: dc.alert_admission(alerts(s, d), 50, ("purchase",), ("login",)).select("alert_id", "verdict"), """WITH a AS (SELECT event_id AS alert_id, ts, event_type AS kind, concat_ws('-', event_type, CAST(user_id AS VARCHAR), CAST(CAST(ts AS DATE) AS VARCHAR)) AS k FROM events),
b AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts, alert_id) = 1 AS first, date_trunc('week', ts) AS wk FROM a),
c AS (SELECT *, sum(CASE WHEN kind NOT IN ('login', 'purchase') AND first THEN 1 ELSE 0 END) OVER (PARTITION BY wk ORDER BY ts, alert_id ROWS UNBOUNDED PRECEDING) AS used FROM b)
SELECT alert_id, CASE WHEN kind = 'login' THEN 'disabled' WHEN NOT first THEN 'duplicate' WHEN kind <> 'purchase' AND used > 50 THEN 'capped' ELSE 'sent' END AS verdict FROM c""")

# actions on weekly plans: the week of the event is the plan
logged = lambda s, d: t(s, d, "events").select(F.date_trunc("week", "ts").cast("date").cast("string").alias("plan_id"), F.col("event_id").alias("item_key"), F.col("event_type").alias("action"), F.col("ts").alias("acted_at"))
weeks = lambda s, d: logged(s, d).select("plan_id", F.col("plan_id").cast("date").alias("trade_date")).distinct()
register("c69_action_log", lambda s, d: dc.action_log(weeks(s, d), logged(s, d), "2024-01-08", "2030-01-01").select("trade_date", "item_key", "action"), "SELECT CAST(date_trunc('week', ts) AS DATE) AS trade_date, event_id AS item_key, event_type AS action FROM events WHERE date_trunc('week', ts) >= DATE '2024-01-08'")
register("c69_action_counts", lambda s, d: dc.action_counts(dc.action_log(weeks(s, d), logged(s, d), "2000-01-01", "2100-01-01")), "SELECT event_type AS action, count(*) AS n, count(DISTINCT date_trunc('week', ts)) AS days FROM events GROUP BY 1")

# imports: parts as holdings whose symbols are brands' sizes
holdings = lambda s, d: t(s, d, "part").select("p_partkey", F.concat(F.lit("SYM"), (F.col("p_size") % 12).cast("string")).alias("symbol"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("I-"), F.col("p_brand"))).alias("isin"))
traded = lambda s, d: fx.symbol_map(s, d).select("company_id", "symbol", F.concat(F.lit("I-"), F.col("company_id")).alias("isin"), F.col("valid_to").alias("trade_date"))
IMPORT = with_views("symbol_map") + """, m AS (SELECT symbol, arg_max(company_id, (valid_to, company_id)) AS company_id FROM symbol_map GROUP BY 1),
h AS (SELECT p_partkey, concat('SYM', CAST(p_size % 12 AS VARCHAR)) AS symbol, CASE WHEN p_partkey % 2 = 0 THEN concat('I-', p_brand) END AS isin FROM part),
j AS (SELECT h.*, m.company_id, CASE WHEN m.company_id IS NULL THEN 'unknown' WHEN isin <> concat('I-', m.company_id) THEN 'isin_conflict' END AS reason FROM h LEFT JOIN m USING (symbol))
"""
register("c66_match_import", lambda s, d: dc.match_import(holdings(s, d), traded(s, d))[0], IMPORT + "SELECT p_partkey, symbol, isin, company_id FROM j WHERE reason IS NULL")
register("c66_import_rejects", lambda s, d: dc.match_import(holdings(s, d), traded(s, d))[1], IMPORT + "SELECT p_partkey, symbol, isin, reason FROM j WHERE reason IS NOT NULL")

# delivery, filings, facts
register("c10_company_delivery", lambda s, d: r6(pr.company_delivery(fx.panel(s, d), fx.bars(s, d).where("volume >= 5"))), with_views("panel") + """SELECT company_id, trade_date, CASE WHEN series IN ('BE', 'BZ') THEN 100.0 WHEN volume >= 5 THEN round(delivery_pct, 6) END AS delivery_pct,
  CASE WHEN series IN ('BE', 'BZ') THEN 'rule' WHEN volume >= 5 THEN 'reported' END AS delivery_source FROM panel""")
filed = lambda s, d: fx.filings(s, d).withColumnRenamed("company_id", "brand").withColumn("symbol", F.concat(F.lit("SYM"), (F.col("filing_id") % 10).cast("string"))).drop("brand")
spans = lambda s, d: fx.symbol_map(s, d).select("symbol", "company_id", F.col("valid_from").alias("first_day"), F.col("valid_to").alias("last_day"))
register("c31_results_targets", lambda s, d: pr.results_targets(filed(s, d), spans(s, d)).select("company_id", "period_to", "filing_id", "published_at"), with_views("filings", "symbol_map") + """, f AS (SELECT *, concat('SYM', CAST(filing_id % 10 AS VARCHAR)) AS symbol FROM filings),
j AS (
  SELECT f.period_to, f.filing_id, f.published_at, f.consolidated, m.company_id FROM f JOIN symbol_map m ON m.symbol = f.symbol AND valid_from <= CAST(published_at AS DATE) + 120 AND valid_to >= CAST(published_at AS DATE)
  QUALIFY row_number() OVER (PARTITION BY f.filing_id ORDER BY valid_from DESC, m.company_id) = 1)
SELECT company_id, period_to, filing_id, published_at FROM j QUALIFY row_number() OVER (PARTITION BY company_id, period_to ORDER BY consolidated DESC, published_at, filing_id) = 1""")
register("c32_load_fundamentals", lambda s, d: pr.load_fundamentals(fx.filings(s, d).withColumnRenamed("published_at", "fetched_at")).select("company_id", "period_to", "filing_id"), with_views("filings") + "SELECT company_id, period_to, arg_max(filing_id, (published_at, filing_id)) AS filing_id FROM filings GROUP BY 1, 2")

# greedy buys: the recursion carries an account's cash from one candidate to the next
GREEDY = with_views("scored").replace("WITH", "WITH RECURSIVE", 1) + """, b AS (SELECT trade_date AS account, CAST(count(*) * 1000 AS DOUBLE) AS budget FROM scored GROUP BY 1),
c AS (
  SELECT s.trade_date AS account, CAST(row_id AS VARCHAR) AS company_id, CAST(100 + row_id % 700 AS DOUBLE) AS close, expected_gain, least(budget, 4000.0) AS v
  FROM scored s JOIN b ON b.account = s.trade_date WHERE p >= 0.8),
e AS (SELECT *, round(""" + EDGE.format(v="v") + """, 9) AS edge FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY edge DESC, company_id, close) AS k FROM e WHERE edge > 0),
g AS (
  SELECT account, CAST(0 AS BIGINT) AS k, budget AS cash, 0 AS n, CAST(NULL AS VARCHAR) AS company_id, CAST(NULL AS BIGINT) AS quantity, CAST(NULL AS DOUBLE) AS price FROM b
  UNION ALL
  SELECT account, k, CASE WHEN ok THEN cash - q * close ELSE cash END, n + CAST(ok AS INT), CASE WHEN ok THEN cid END, CASE WHEN ok THEN q END, CASE WHEN ok THEN close END
  FROM (SELECT g.account, o.k, cash, n, o.company_id AS cid, o.close, CAST(floor(least(cash, 4000.0) / o.close) AS BIGINT) AS q, floor(least(cash, 4000.0) / o.close) * o.close >= 3000 AND n < 5 AS ok
        FROM g JOIN o ON o.account = g.account AND o.k = g.k + 1) z)
SELECT account, company_id, quantity, price FROM g WHERE company_id IS NOT NULL"""
register("c49_plan_opportunities", opportunities, GREEDY)
