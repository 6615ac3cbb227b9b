"""Queries of projections, joins, aggregates, limits and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import register
from ..operators import intervals as iv
from ..operators import tables as tb
from . import fixtures as fx
from .sqltext import with_views

t = fx.table
KEYS = ["company_id", "trade_date"]
B, PX = with_views("bars"), with_views("px")

# projections and predicates
register("p01_strict_projection", lambda s, d: tb.strict_cast(t(s, d, "lineitem").select(F.concat(F.lit(" "), F.col("l_quantity").cast("int").cast("string")).alias("q"), F.col("l_shipdate").cast("date").cast("string").alias("day")), {"q": "long", "day": "date"}), "SELECT CAST(l_quantity AS BIGINT) AS q, CAST(l_shipdate AS DATE) AS day FROM lineitem")
register("p02_rename_select", lambda s, d: t(s, d, "orders").withColumnRenamed("o_orderkey", "order_id").select("order_id", "o_totalprice").drop("o_custkey"), "SELECT o_orderkey AS order_id, o_totalprice FROM orders")
register("p03_in_list", lambda s, d: t(s, d, "lineitem").where(F.col("l_returnflag").isin("R", "A")).select("l_orderkey", "l_linenumber", "l_returnflag"), "SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag IN ('R', 'A')")
register("p04_prefix", lambda s, d: t(s, d, "part").where(F.col("p_brand").startswith("Brand#1") | F.col("p_brand").like("Brand#2%")).select("p_partkey", "p_brand"), "SELECT p_partkey, p_brand FROM part WHERE p_brand LIKE 'Brand#1%' OR p_brand LIKE 'Brand#2%'")
register("p05_null_aware_or", lambda s, d: fx.market(s, d).where(F.col("vix").isNull() | (F.col("vix") > 100)).select("trade_date"), with_views("market") + "SELECT trade_date FROM market WHERE vix IS NULL OR vix > 100")
register("p06_case", lambda s, d: fx.bars(s, d).select(*KEYS, F.when(F.col("delivery_pct") == 100, 100.0).otherwise(F.round("delivery_pct", 6)).alias("delivery"), F.when(F.col("delivery_pct") == 100, "rule").otherwise("reported").alias("provenance")), B + "SELECT company_id, trade_date, CASE WHEN delivery_pct = 100 THEN 100.0 ELSE round(delivery_pct, 6) END AS delivery, CASE WHEN delivery_pct = 100 THEN 'rule' ELSE 'reported' END AS provenance FROM bars")
register("p07_coalesce", lambda s, d: fx.market(s, d).select("trade_date", F.round(F.coalesce("vix", F.lit(0.0)), 6).alias("vix")), with_views("market") + "SELECT trade_date, round(coalesce(vix, 0), 6) AS vix FROM market")
register("p08_row_min_max", lambda s, d: fx.bars(s, d).select(*KEYS, F.greatest("open", "close").alias("top"), F.least("open", "close").alias("bottom")), B + "SELECT company_id, trade_date, greatest(open, close) AS top, least(open, close) AS bottom FROM bars")
BENT = "SELECT company_id, trade_date, open, CASE WHEN volume > 90 THEN low - 1 ELSE high END AS high, low, close, CASE WHEN volume < 3 THEN -1 ELSE volume END AS volume FROM bars"
register("p09_ohlc_integrity", lambda s, d: tb.ohlc_violations(fx.bars(s, d).withColumns({"high": F.when(F.col("volume") > 90, F.col("low") - 1).otherwise(F.col("high")), "volume": F.when(F.col("volume") < 3, -1.0).otherwise(F.col("volume"))})).select(*KEYS), B + f"SELECT company_id, trade_date FROM ({BENT}) b WHERE least(open, high, low, close) <= 0 OR high < low - 1e-6 OR greatest(open, close) > high + 1e-6 OR least(open, close) < low - 1e-6 OR volume < 0")
W = lambda: Window.partitionBy("company_id").orderBy("trade_date")
SPLIT = "list_min([" + ", ".join(f"abs(raw - {r!r}) / {r!r}" for r in tb.SPLIT_RATIOS) + "])"
register("p10_split_ratio", lambda s, d: fx.bars(s, d).select(*KEYS, (F.col("close") / F.lag("close").over(W())).alias("raw"), F.lag("close").over(W()).alias("prior"), F.datediff("trade_date", F.lag("trade_date").over(W())).alias("gap")).where(tb.looks_like_split(F.col("raw"), F.col("prior"), F.col("gap"))).select(*KEYS, F.round("raw", 6).alias("raw")), B + f", x AS (SELECT company_id, trade_date, close / lag(close) OVER w AS raw, lag(close) OVER w AS prior, trade_date - lag(trade_date) OVER w AS gap FROM bars WINDOW w AS (PARTITION BY company_id ORDER BY trade_date)) SELECT company_id, trade_date, round(raw, 6) AS raw FROM x WHERE raw <= 0.55 AND prior >= 10 AND gap <= 10 AND {SPLIT} <= 0.03")
register("p11_stress", lambda s, d: fx.market(s, d).select("trade_date", tb.stress(F.col("nifty500") - 1500, F.col("vix") / 1000, 0.3).alias("stress")), with_views("market") + "SELECT trade_date, coalesce(nifty500 < 1500 AND vix / 1000 >= 0.3, false) AS stress FROM market")


def candidates(s, d):
    return fx.scored(s, d).select("row_id", "company_id", F.when(F.col("p") > 0.1, F.col("p")).alias("score"), (F.col("row_id") % 7 == 0).alias("blocked"), (F.col("row_id") % 11 == 0).alias("is_t2t"), (F.col("row_id") % 600).alias("sessions"))


CAND = with_views("scored") + ", cand AS (SELECT row_id, company_id, CASE WHEN p > 0.1 THEN p END AS score, row_id % 7 = 0 AS blocked, row_id % 11 = 0 AS is_t2t, row_id % 600 AS sessions FROM scored)\n"
register("p12_candidates", lambda s, d: tb.eligible(candidates(s, d), t(s, d, "customer").where("c_custkey < 30").select(F.col("c_custkey").alias("company_id"))).select("row_id", "company_id", "score"), CAND + "SELECT row_id, company_id, score FROM cand WHERE score IS NOT NULL AND NOT blocked AND NOT is_t2t AND sessions >= 250 AND company_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey < 30)")
register("p13_clip", lambda s, d: fx.market(s, d).select("trade_date", F.round(tb.clip(F.col("vix"), 100, 300), 6).alias("vix")), with_views("market") + "SELECT trade_date, round(CASE WHEN vix IS NOT NULL THEN least(greatest(vix, 100), 300) END, 6) AS vix FROM market")
register("p14_inf_to_null", lambda s, d: tb.infinite_to_null(t(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(F.col("l_tax")).alias("x"))), "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount <> 0 THEN l_tax END AS x FROM lineitem")
register("p15_feature_version", lambda s, d: fx.bars(s, d).withColumn("version", F.substring(F.sha2(F.when(F.year("trade_date") < 1996, "ret_5").otherwise("ret_5,vol_20"), 256), 1, 16)).where(F.col("version") == F.substring(F.sha2(F.lit("ret_5,vol_20"), 256), 1, 16)).select(*KEYS, "version"), B + "SELECT company_id, trade_date, substr(sha256('ret_5,vol_20'), 1, 16) AS version FROM bars WHERE year(trade_date) >= 1996")
register("p16_row_key", lambda s, d: fx.numbered(t(s, d, "orders"), ("o_orderkey",), F.shiftright("o_orderkey", 16), "row").select((F.col("row") - 1).alias("row"), "o_orderkey"), "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row, o_orderkey FROM orders")
register("p17_explode_payload", lambda s, d: t(s, d, "orders").groupBy("o_custkey").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("st"))).alias("items"))).alias("payload")).select("o_custkey", F.explode(F.from_json("payload", "items array<struct<id:bigint,st:string>>")["items"]).alias("i")).select("o_custkey", "i.id", "i.st"), "SELECT o_custkey, o_orderkey AS id, o_orderstatus AS st FROM orders")
register("p18_typed_nulls", lambda s, d: t(s, d, "orders").select("o_orderkey", F.lit(None).cast("double").alias("reaction")), "SELECT o_orderkey, CAST(NULL AS DOUBLE) AS reaction FROM orders")

# joins
register("j01_inner", lambda s, d: t(s, d, "orders").join(t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name"), "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
register("j02_left", lambda s, d: fx.bars(s, d).join(fx.market(s, d).where("vix is not null"), "trade_date", "left").select(*KEYS, F.round("vix", 6).alias("vix")), with_views("bars", "market") + "SELECT company_id, trade_date, round(vix, 6) AS vix FROM bars LEFT JOIN (SELECT * FROM market WHERE vix IS NOT NULL) m USING (trade_date)")
register("j03_semi", lambda s, d: fx.bars(s, d).join(fx.factors(s, d), "company_id", "left_semi").select(*KEYS), with_views("factors") + "SELECT company_id, trade_date FROM bars WHERE company_id IN (SELECT company_id FROM factors)")
register("j04_anti", lambda s, d: t(s, d, "customer").join(t(s, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey"), "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
symbols = lambda s, d: fx.bars(s, d).withColumn("symbol", F.concat(F.lit("SYM"), (F.dayofyear("trade_date") % 10).cast("string"))).select("trade_date", "symbol", F.col("company_id").alias("own"))
SYM = with_views("bars", "symbol_map") + ", rows_ AS (SELECT trade_date, concat('SYM', CAST(dayofyear(trade_date) % 10 AS VARCHAR)) AS symbol, company_id AS own FROM bars)\n"
register("j05_validity_interval", lambda s, d: iv.valid_at(symbols(s, d), fx.symbol_map(s, d), "symbol", "trade_date").select("r.trade_date", "r.symbol", "r.own", "i.company_id"), SYM + "SELECT trade_date, r.symbol, own, i.company_id FROM rows_ r JOIN symbol_map i ON r.symbol = i.symbol AND trade_date BETWEEN valid_from AND valid_to")


def asof(direction, strict, swap=False):
    def run(s, d):
        f, b = fx.factors(s, d).select("company_id", "ex_date", "price_factor"), fx.bars(s, d).select(*KEYS, "close")
        if swap:
            return iv.asof_join(b.select(*KEYS), f, "company_id", "trade_date", "ex_date", ["price_factor"], direction, strict).select(*KEYS, "price_factor", F.col("matched_ex_date").alias("ex_date"))
        return iv.asof_join(f, b, "company_id", "ex_date", "trade_date", ["close"], direction, strict).select("company_id", "ex_date", "close", F.col("matched_trade_date").alias("matched"))

    return run


def asof_sql(op, swap=False):
    if swap:
        return with_views("factors") + f"SELECT b.company_id, b.trade_date, f.price_factor, f.ex_date FROM bars b ASOF LEFT JOIN factors f ON b.company_id = f.company_id AND b.trade_date {op} f.ex_date"
    return with_views("factors") + f"SELECT f.company_id, f.ex_date, b.close, b.trade_date AS matched FROM factors f ASOF LEFT JOIN bars b ON f.company_id = b.company_id AND f.ex_date {op} b.trade_date"


register("j06_asof_backward_strict", asof("backward", True), asof_sql(">"))
register("j07_asof_forward_strict", asof("forward", True, True), asof_sql("<", True))
register("j08_asof_forward_inclusive", asof("forward", False), asof_sql("<="))
register("j09_asof_backward_inclusive", asof("backward", False, True), asof_sql(">=", True))
register("j10_interval_overlap", lambda s, d: iv.overlapping(fx.bars(s, d), fx.flags(s, d), "company_id", "trade_date", 7), with_views("flags") + "SELECT DISTINCT b.company_id, b.trade_date FROM bars b JOIN flags f ON b.company_id = f.company_id AND from_date <= trade_date + 7 AND to_date >= trade_date")
gaps = lambda s, d: fx.bars(s, d).select(*KEYS, F.lag("trade_date").over(W()).alias("prev_date"))
register("j11_not_exists_between", lambda s, d: iv.without_between(gaps(s, d).where("prev_date is not null"), fx.factors(s, d), "company_id", "prev_date", "trade_date", "ex_date"), with_views("factors") + ", g AS (SELECT company_id, trade_date, lag(trade_date) OVER (PARTITION BY company_id ORDER BY trade_date) AS prev_date FROM bars) SELECT company_id, trade_date, prev_date FROM g WHERE prev_date IS NOT NULL AND NOT EXISTS (SELECT 1 FROM factors f WHERE f.company_id = g.company_id AND ex_date > prev_date AND ex_date <= trade_date)")
register("j12_segment_id", lambda s, d: iv.with_segment(fx.bars(s, d).select(*KEYS), fx.breaks(s, d)), with_views("panel") + "SELECT company_id, trade_date, segment FROM panel")
register("j13_last_two_closes", lambda s, d: fx.bars(s, d).withColumn("prev_close", F.lag("close").over(W())).withColumn("rn", F.row_number().over(Window.partitionBy("company_id").orderBy(F.desc("trade_date")))).where("rn = 1").select(*KEYS, "close", "prev_close"), B + ", r AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY trade_date DESC) AS rn FROM bars) SELECT a.company_id, a.trade_date, a.close, b.close AS prev_close FROM r a LEFT JOIN r b ON a.company_id = b.company_id AND b.rn = 2 WHERE a.rn = 1")


def j14(s, d):
    o = iv.session_ordinals(fx.bars(s, d))
    months = o.groupBy(F.date_format("trade_date", "yyyy-MM").alias("month")).agg(F.min("n").alias("n0"))
    return iv.ordinal_band(months, o, 10)


register("j14_ordinal_band", j14, B + ", o AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS n FROM (SELECT DISTINCT trade_date FROM bars) x), m AS (SELECT strftime(trade_date, '%Y-%m') AS month, min(n) AS n0 FROM o GROUP BY 1) SELECT month, trade_date FROM m JOIN o ON n BETWEEN n0 - 10 AND n0 - 1")
register("j15_using", lambda s, d: fx.bars(s, d).select(*KEYS, "close").join(fx.panel(s, d).select(*KEYS, "segment"), KEYS), with_views("panel") + "SELECT company_id, trade_date, b.close, p.segment FROM bars b JOIN panel p USING (company_id, trade_date)")


def j16(s, d):
    m = fx.meetings(s, d).where("is_results").withColumnRenamed("company_id", "k")
    w = fx.bars(s, d).select(*KEYS)
    j = w.join(m, (F.col("company_id") == F.col("k")) & (F.col("announced_at") <= F.col("trade_date").cast("timestamp_ntz")) & (F.col("meeting_date") > F.col("trade_date")))
    return j.groupBy(*KEYS).agg(F.min("meeting_date").alias("next_meeting"))


register("j16_event_filter", j16, with_views("bars", "meetings") + "SELECT b.company_id, trade_date, min(meeting_date) AS next_meeting FROM bars b JOIN meetings m ON b.company_id = m.company_id AND announced_at <= trade_date AND meeting_date > trade_date WHERE is_results GROUP BY 1, 2")


def j17(s, d):
    rows = symbols(s, d).withColumn("isin", F.substring("own", 7, 2).cast("int"))
    exact = fx.bars(s, d).select(F.substring("company_id", 7, 2).cast("int").alias("isin"), "company_id").where("isin % 2 = 0").distinct()
    return iv.fallback_map(rows, exact, "isin", fx.symbol_map(s, d), "symbol", "trade_date").select("trade_date", "symbol", "own", "company_id")


register("j17_fallback_mapping", j17, SYM + "SELECT trade_date, symbol, own, own AS company_id FROM rows_ WHERE CAST(substr(own, 7, 2) AS INT) % 2 = 0 UNION ALL SELECT trade_date, r.symbol, own, i.company_id FROM rows_ r JOIN symbol_map i ON r.symbol = i.symbol AND trade_date BETWEEN valid_from AND valid_to WHERE CAST(substr(own, 7, 2) AS INT) % 2 <> 0")


def j18(s, d):
    """Every order's symbol: who held it on the order's day, else who holds it now."""
    m = fx.symbol_map(s, d)
    rows = t(s, d, "orders").select("o_orderkey", F.concat(F.lit("SYM"), (F.col("o_custkey") % 10).cast("string")).alias("symbol"), F.col("o_orderdate").cast("date").alias("day"))
    at = iv.valid_at(rows, m, "symbol", "day").groupBy("r.o_orderkey").agg(F.min("i.company_id").alias("company_id"))
    now = m.where("valid_to = '9999-12-31'").groupBy("symbol").agg(F.min("company_id").alias("company_id"))
    now = rows.join(now, "symbol").select("o_orderkey", "company_id")
    return iv.coalesce_maps(rows, at, now, "o_orderkey").select("o_orderkey", "symbol", "company_id")


register("j18_at_date_else_current", j18, with_views("symbol_map") + """, r AS (SELECT o_orderkey, concat('SYM', CAST(o_custkey % 10 AS VARCHAR)) AS symbol, CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT o_orderkey, symbol, coalesce((SELECT min(company_id) FROM symbol_map m WHERE m.symbol = r.symbol AND r.day BETWEEN valid_from AND valid_to),
  (SELECT min(company_id) FROM symbol_map m WHERE m.symbol = r.symbol AND valid_to = DATE '9999-12-31')) AS company_id FROM r""")
register("j19_open_interval_lookup", lambda s, d: fx.symbol_map(s, d).where("valid_to = '9999-12-31'").select("company_id", "symbol", "valid_from"), with_views("symbol_map") + "SELECT company_id, symbol, valid_from FROM symbol_map WHERE valid_to = DATE '9999-12-31'")


def j20(s, d):
    b = fx.bars(s, d).select(*KEYS)
    out = b.join(fx.market(s, d), "trade_date", "left").join(fx.factors(s, d).withColumnRenamed("ex_date", "trade_date"), KEYS, "left").join(fx.breaks(s, d).withColumnRenamed("break_date", "trade_date").withColumn("is_break", F.lit(True)), KEYS, "left")
    return out.select(*KEYS, F.round("nifty500", 6).alias("nifty500"), "price_factor", F.coalesce("is_break", F.lit(False)).alias("is_break"))


register("j20_multiway_left", j20, with_views("bars", "market", "factors", "breaks") + "SELECT b.company_id, b.trade_date, round(nifty500, 6) AS nifty500, price_factor, k.break_date IS NOT NULL AS is_break FROM bars b LEFT JOIN market m ON m.trade_date = b.trade_date LEFT JOIN factors f ON f.company_id = b.company_id AND f.ex_date = b.trade_date LEFT JOIN breaks k ON k.company_id = b.company_id AND k.break_date = b.trade_date")


def j21(s, d):
    cuts = s.range(1, 10).select((F.col("id") / 10).alias("cutoff"))
    # the grid of cutoffs is a constant of nine rows
    return F.broadcast(cuts).join(fx.scored(s, d), F.col("p") >= F.col("cutoff")).groupBy("cutoff").agg(F.count("*").alias("n"), F.round(F.avg(F.col("label").cast("double")), 6).alias("precision"))


register("j21_cutoff_grid", j21, with_views("scored") + "SELECT c / 10.0 AS cutoff, count(*) AS n, round(avg(CAST(label AS DOUBLE)), 6) AS precision FROM range(1, 10) g(c) JOIN scored ON p >= c / 10.0 GROUP BY 1")

# aggregates
register("a01_hash_aggregate", lambda s, d: t(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.min("l_tax").alias("lo"), F.max("l_tax").alias("hi"), F.round(F.avg("l_discount"), 6).alias("disc")), "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, min(l_tax) AS lo, max(l_tax) AS hi, round(avg(l_discount), 6) AS disc FROM lineitem GROUP BY 1, 2")
register("a02_exact_median", lambda s, d: fx.bars(s, d).groupBy("company_id").agg(F.round(F.median("value_inr"), 4).alias("median_value")), B + "SELECT company_id, round(median(value_inr), 4) AS median_value FROM bars GROUP BY 1")
register("a03_arg_max", lambda s, d: fx.bars(s, d).groupBy("company_id").agg(F.max_by("close", "trade_date").alias("last_close")), B + "SELECT company_id, max_by(close, trade_date) AS last_close FROM bars GROUP BY 1")
register("a04_having", lambda s, d: t(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n >= 12"), "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 12")
register("a05_product", lambda s, d: fx.factors(s, d).groupBy("company_id").agg(F.round(F.product("price_factor"), 9).alias("factor")), with_views("factors") + "SELECT company_id, round(product(price_factor), 9) AS factor FROM factors GROUP BY 1")
register("a06_sorted_distinct_string", lambda s, d: t(s, d, "orders").groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_set("o_orderstatus")), ",").alias("kinds")), "SELECT o_custkey, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS kinds FROM orders GROUP BY 1")
register("a07_filter_counts", lambda s, d: fx.attempts(s, d).groupBy("source_id").agg(F.expr("count(*) FILTER (WHERE status = 'success')").alias("loaded"), F.expr("count(*) FILTER (WHERE status = 'not_available')").alias("no_file"), F.expr("count(*) FILTER (WHERE status = 'failed')").alias("failed")), with_views("attempts") + "SELECT source_id, count(*) FILTER (WHERE status = 'success') AS loaded, count(*) FILTER (WHERE status = 'not_available') AS no_file, count(*) FILTER (WHERE status = 'failed') AS failed FROM attempts GROUP BY 1")
register("a08_conditional_distinct", lambda s, d: fx.attempts(s, d).groupBy("partition_key").agg(F.countDistinct(F.when(F.col("status") == "success", F.col("source_id"))).alias("sources")), with_views("attempts") + "SELECT partition_key, count(DISTINCT CASE WHEN status = 'success' THEN source_id END) AS sources FROM attempts GROUP BY 1")
register("a09_count_distinct", lambda s, d: t(s, d, "lineitem").agg(F.countDistinct("l_orderkey").alias("orders"), F.countDistinct("l_partkey", "l_suppkey").alias("pairs")), "SELECT count(DISTINCT l_orderkey) AS orders, count(DISTINCT (l_partkey, l_suppkey)) AS pairs FROM lineitem")
register("a10_bool_and", lambda s, d: fx.attempts(s, d).groupBy("partition_key").agg(F.bool_and(F.col("status") != "failed").alias("all_fine"), F.bool_or(F.col("status") == "failed").alias("any_failed")), with_views("attempts") + "SELECT partition_key, bool_and(status <> 'failed') AS all_fine, bool_or(status = 'failed') AS any_failed FROM attempts GROUP BY 1")
register("a11_pivot", lambda s, d: t(s, d, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.max("o_totalprice")), "SELECT o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS \"F\", max(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS \"O\", max(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END) AS \"P\" FROM orders GROUP BY 1")
register("a12_first_last", lambda s, d: fx.filings(s, d).groupBy("company_id", "period_to").agg(F.min("published_at").alias("first_published"), F.min_by("filing_id", F.struct("published_at", "filing_id")).alias("first_filing")), with_views("filings") + "SELECT company_id, period_to, min(published_at) AS first_published, arg_min(filing_id, (published_at, filing_id)) AS first_filing FROM filings GROUP BY 1, 2")
register("a14_ratio_rounded", lambda s, d: fx.bars(s, d).groupBy("company_id").agg(F.round(100 * F.avg((F.col("volume") > 20).cast("double")), 4).alias("pct")), B + "SELECT company_id, round(100 * avg(CAST(volume > 20 AS DOUBLE)), 4) AS pct FROM bars GROUP BY 1")
register("a15_distinct", lambda s, d: t(s, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct(), "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
register("a16_duplicate_keys", lambda s, d: tb.duplicate_keys(t(s, d, "lineitem"), ["l_orderkey", "l_linenumber"]), "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
register("a17_null_profile", lambda s, d: tb.null_profile(fx.market(s, d), ["trade_date", "nifty500", "vix"]), with_views("market") + "SELECT CAST(sum(CAST(trade_date IS NULL AS INT)) AS BIGINT) AS trade_date_nulls, CAST(sum(CAST(nifty500 IS NULL AS INT)) AS BIGINT) AS nifty500_nulls, CAST(sum(CAST(vix IS NULL AS INT)) AS BIGINT) AS vix_nulls FROM market")
register("a18_scalar_counts", lambda s, d: t(s, d, "orders").agg(F.count("*").alias("orders"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("finished"), F.count(F.when(F.col("o_totalprice") > 250000, 1)).alias("large")), "SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS finished, (SELECT count(*) FROM orders WHERE o_totalprice > 250000) AS large")
register("a19_year_rollup", lambda s, d: fx.market(s, d).groupBy(F.year("trade_date").cast("long").alias("year")).agg(F.count("*").alias("sessions"), F.round(F.min("nifty500"), 6).alias("lowest"), F.round(F.avg("nifty500"), 6).alias("mean"), F.count(F.when(F.col("nifty500") < 1400, 1)).alias("below")), with_views("market") + "SELECT year(trade_date) AS year, count(*) AS sessions, round(min(nifty500), 6) AS lowest, round(avg(nifty500), 6) AS mean, count(*) FILTER (WHERE nifty500 < 1400) AS below FROM market GROUP BY 1")

# sorts, limits, sets
register("l01_mixed_sort", lambda s, d: fx.market(s, d).orderBy(F.desc_nulls_last("vix"), F.asc("trade_date")).select("trade_date", F.round("vix", 6).alias("vix")), with_views("market") + "SELECT trade_date, round(vix, 6) AS vix FROM (SELECT * FROM market ORDER BY vix DESC NULLS LAST, trade_date) x")
register("l02_limit", lambda s, d: t(s, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(15).select("o_orderkey", "o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
register("l04_best_row_per_key", lambda s, d: tb.keep_last(fx.filings(s, d), ["company_id", "period_to"], F.desc("consolidated"), F.asc("published_at"), F.asc("filing_id")).select("company_id", "period_to", "filing_id", "consolidated"), with_views("filings") + "SELECT company_id, period_to, filing_id, consolidated FROM filings QUALIFY row_number() OVER (PARTITION BY company_id, period_to ORDER BY consolidated DESC, published_at, filing_id) = 1")
register("l05_keep_last", lambda s, d: tb.keep_last(fx.attempts(s, d), ["source_id"], F.desc("started_at"), F.desc("job_run_id")).select("source_id", "job_run_id"), with_views("attempts") + "SELECT source_id, job_run_id FROM attempts QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, job_run_id DESC) = 1")
PRIORITY = "CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END"
register("l06_priority_order", lambda s, d: t(s, d, "orders").withColumn("rn", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.expr(PRIORITY), F.desc("o_totalprice"), "o_orderkey")).cast("long")).select("o_custkey", "o_orderkey", "rn"), f"SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY {PRIORITY}, o_totalprice DESC, o_orderkey) AS rn FROM orders")
two = lambda s, d: (t(s, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")), t(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")))
register("u01_union_all", lambda s, d: tb.union_all(list(two(s, d))), "SELECT c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
register("u02_relaxed_union", lambda s, d: tb.relaxed_union(t(s, d, "nation").select(F.col("n_nationkey").alias("k")), t(s, d, "orders").select(F.col("o_totalprice").alias("k")), {"k": "double"}), "SELECT CAST(n_nationkey AS DOUBLE) AS k FROM nation UNION ALL SELECT o_totalprice FROM orders")
register("u03_diagonal_union", lambda s, d: tb.union_all([t(s, d, "orders").select("o_orderkey", "o_orderstatus"), t(s, d, "part").select("p_brand")], True), "SELECT o_orderkey, o_orderstatus, NULL AS p_brand FROM orders UNION ALL SELECT NULL, NULL, p_brand FROM part")
register("u04_distinct_rows", lambda s, d: t(s, d, "orders").select("o_custkey", "o_orderstatus").distinct(), "SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
register("u05_set_difference", lambda s, d: t(s, d, "part").select("p_partkey").join(t(s, d, "lineitem").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti"), "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)")
def settings(s, d, name, number, m):
    """A settings table of a whole table's keys: names by area, values by remainder."""
    k = F.col(number)
    return t(s, d, name).select(F.concat(F.when(k % 3 == 0, "gate.").when(k % 3 == 1, "plan.").otherwise("model."), k.cast("string")).alias("key"), (k % m).cast("string").alias("value"))


old_settings, new_settings = (lambda s, d: settings(s, d, "customer", "c_custkey", 10)), (lambda s, d: settings(s, d, "part", "p_partkey", 20))
SET = "SELECT concat(CASE {k} % 3 WHEN 0 THEN 'gate.' WHEN 1 THEN 'plan.' ELSE 'model.' END, CAST({k} AS VARCHAR)) AS key, CAST({k} % {m} AS VARCHAR) AS value FROM {t}"
DIFF = f"""WITH a AS ({SET.format(k="c_custkey", m=10, t="customer")}), b AS ({SET.format(k="p_partkey", m=20, t="part")})
SELECT coalesce(a.key, b.key) AS key, a.value AS old, b.value AS new FROM a FULL JOIN b ON a.key = b.key WHERE a.value IS DISTINCT FROM b.value"""
register("u06_key_union_diff", lambda s, d: tb.changed_keys(old_settings(s, d), new_settings(s, d)), DIFF)
IMPACT = "CASE WHEN starts_with(key, 'model.') THEN 'retrain' WHEN starts_with(key, 'gate.') THEN 'gate' ELSE 'plan' END"
register("c60_settings_diff", lambda s, d: tb.changed_keys(old_settings(s, d), new_settings(s, d)).withColumn("impact", F.when(F.col("key").startswith("model."), "retrain").when(F.col("key").startswith("gate."), "gate").otherwise("plan")), f"SELECT *, {IMPACT} AS impact FROM ({DIFF}) x")

# scalar functions
register("f01_strings", lambda s, d: t(s, d, "part").select("p_partkey", F.upper(F.trim("p_name")).alias("up"), F.regexp_replace("p_type", "[AEIOU]", "").alias("no_vowels"), F.lower("p_brand").rlike("#1").alias("has_one"), F.length("p_name").cast("long").alias("n"), F.element_at(F.split("p_type", " "), -1).alias("last_word"), F.substring("p_name", 1, 5).alias("head"), F.format_string("%s-%d", "p_brand", "p_size").alias("tag")), "SELECT p_partkey, upper(trim(p_name)) AS up, regexp_replace(p_type, '[AEIOU]', '', 'g') AS no_vowels, contains(lower(p_brand), '#1') AS has_one, length(p_name) AS n, string_split(p_type, ' ')[-1] AS last_word, substr(p_name, 1, 5) AS head, concat(p_brand, '-', CAST(p_size AS VARCHAR)) AS tag FROM part")
register("f02_regex_extract", lambda s, d: fx.action_text(s, d).select("p_partkey", F.regexp_extract("subject", r"(?i)bonus\s+(\d+):(\d+)", 1).alias("a"), F.regexp_extract("subject", r"(?i)bonus\s+(\d+):(\d+)", 2).alias("b")), with_views("action_text") + r"SELECT p_partkey, regexp_extract(subject, '(?i)bonus\s+(\d+):(\d+)', 1) AS a, regexp_extract(subject, '(?i)bonus\s+(\d+):(\d+)', 2) AS b FROM action_text")
fy = lambda c: F.year(c) - F.when(F.month(c) < 4, 1).otherwise(0)
register("f03_dates", lambda s, d: fx.bars(s, d).select("trade_date").distinct().select("trade_date", F.date_trunc("week", "trade_date").cast("date").alias("week"), F.date_format("trade_date", "yyyy-MM").alias("month"), F.trunc("trade_date", "quarter").alias("quarter"), F.next_day("trade_date", "Mon").alias("next_monday"), fy("trade_date").cast("long").alias("fin_year"), F.weekofyear("trade_date").cast("long").alias("iso_week"), F.add_months("trade_date", 3).alias("plus3"), (F.weekday("trade_date") + 1).cast("long").alias("isodow")), B + "SELECT DISTINCT trade_date, CAST(date_trunc('week', trade_date) AS DATE) AS week, strftime(trade_date, '%Y-%m') AS month, CAST(date_trunc('quarter', trade_date) AS DATE) AS quarter, CAST(date_trunc('week', trade_date) AS DATE) + 7 AS next_monday, year(trade_date) - CASE WHEN month(trade_date) < 4 THEN 1 ELSE 0 END AS fin_year, weekofyear(trade_date) AS iso_week, CAST(trade_date + INTERVAL 3 MONTH AS DATE) AS plus3, isodow(trade_date) AS isodow FROM bars")
register("f04_math", lambda s, d: t(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.ln("l_quantity"), 6).alias("ln"), F.round(F.exp("l_tax"), 6).alias("exp"), F.round(F.sqrt("l_quantity"), 6).alias("sqrt"), F.round(F.log1p("l_discount"), 6).alias("log1p"), F.floor("l_extendedprice").cast("double").alias("floor"), F.abs(-F.col("l_tax")).alias("abs"), F.round(F.pow("l_tax", F.lit(2)), 6).alias("pow")), "SELECT l_orderkey, l_linenumber, round(ln(l_quantity), 6) AS ln, round(exp(l_tax), 6) AS exp, round(sqrt(l_quantity), 6) AS sqrt, round(ln(1 + l_discount), 6) AS log1p, floor(l_extendedprice) AS floor, abs(-l_tax) AS abs, round(pow(l_tax, 2), 6) AS pow FROM lineitem")
register("f05_json_hash", lambda s, d: t(s, d, "events").select("event_id", F.substring(F.sha2(F.col("event_type"), 256), 1, 16).alias("mark"), F.get_json_object("props", "$.k").alias("k")), "SELECT event_id, substr(sha256(event_type), 1, 16) AS mark, json_extract_string(props, '$.k') AS k FROM events")
register("f06_series_and_buckets", lambda s, d: t(s, d, "orders").select("o_orderkey", F.when(F.col("o_totalprice") < 100000, "low").when(F.col("o_totalprice") < 250000, "mid").otherwise("high").alias("band"), F.size(F.sequence(F.lit(1), (F.col("o_orderkey") % 5 + 1).cast("int"))).cast("long").alias("n")), "SELECT o_orderkey, CASE WHEN o_totalprice < 100000 THEN 'low' WHEN o_totalprice < 250000 THEN 'mid' ELSE 'high' END AS band, len(range(1, CAST(o_orderkey % 5 + 2 AS BIGINT))) AS n FROM orders")
