"""Queries of the rolling and ranking features."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import register
from ..operators import features as ft
from ..operators import money as mn
from . import fixtures as fx
from .sqltext import with_views

KEYS = ["company_id", "trade_date"]


def rounded(df, *columns, keys=KEYS):
    kinds = dict(df.dtypes)
    return df.select(*keys, *[F.round(c, 6).alias(c) if kinds[c] == "double" else F.col(c) for c in columns])


def features(spark, d):
    return ft.compute_features(fx.panel(spark, d), ft.market_features(fx.market(spark, d)))


BASE = with_views("panel", "market") + """, base AS (
  SELECT p.*, lag(close) OVER s AS prev, ln(close / lag(close) OVER s) AS lr, greatest(high - low, abs(high - lag(close) OVER s), abs(low - lag(close) OVER s)) AS tr,
    CASE WHEN lag(close) OVER s IS NOT NULL THEN greatest(close - lag(close) OVER s, 0) END AS up, CASE WHEN lag(close) OVER s IS NOT NULL THEN greatest(lag(close) OVER s - close, 0) END AS down
  FROM panel p WINDOW s AS (PARTITION BY company_id, segment ORDER BY trade_date)),
mkt AS (SELECT trade_date, ln(nifty500 / lag(nifty500) OVER (ORDER BY trade_date)) AS mlr, nifty500 / lag(nifty500, 20) OVER (ORDER BY trade_date) - 1 AS m20, nifty500 / lag(nifty500, 60) OVER (ORDER BY trade_date) - 1 AS m60 FROM market)
"""


def full(agg: str, x: str, k: int) -> str:
    w = f"(PARTITION BY company_id, segment ORDER BY trade_date ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    call = agg.format(x)
    return f"(CASE WHEN count({x}) OVER {w} = {k} THEN {call} OVER {w} END)"


def avg(x: str, k: int) -> str:
    return full("avg({})", x, k)


LAG = "lag(close, {}) OVER (PARTITION BY company_id, segment ORDER BY trade_date)"
BOTH = "CASE WHEN lr IS NOT NULL AND mlr IS NOT NULL THEN {} END"


def _b60(agg: str, x: str) -> str:
    w = "(PARTITION BY company_id, segment ORDER BY trade_date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"
    return f"(CASE WHEN count({BOTH.format('lr')}) OVER {w} = 60 THEN {agg}({BOTH.format(x)}) OVER {w} END)"


COV = f"({_b60('avg', 'lr * mlr')} - {_b60('avg', 'lr')} * {_b60('avg', 'mlr')})"
BETA = f"({COV} / nullif({_b60('var_samp', 'mlr')}, 0))"
FEATURES: dict[str, dict[str, str]] = {
    "w01_returns": {f"ret_{k}": f"close / {LAG.format(k)} - 1" for k in ft.RETURNS},
    "w03_volatility": {f"vol_{k}": full("stddev_samp({})", "lr", k) for k in (5, 20, 60)},
    "w04_vol_ratio_5_60": {"vol_ratio_5_60": f"{full('stddev_samp({})', 'lr', 5)} / nullif({full('stddev_samp({})', 'lr', 60)}, 0)"},
    "w05_atr_14_pct": {"atr_14_pct": f"{avg('tr', 14)} / close"},
    "w06_hl_vol_20": {"hl_vol_20": f"sqrt({avg('pow(ln(high / low), 2)', 20)} / (4 * ln(2)))"},
    "w07_max_abs_move_20": {"max_abs_move_20": full("max({})", "abs(lr)", 20)},
    "w08_big_move_count_60": {"big_move_count_60": full("sum({})", "CAST(abs(lr) > ln(1.05) AS DOUBLE)", 60)},
    "w09_gap_freq_20": {"gap_freq_20": avg("CAST(abs(open / prev - 1) > 0.02 AS DOUBLE)", 20)},
    "w10_sma_gap": {f"sma_gap_{k}": f"close / {avg('close', k)} - 1" for k in (20, 50, 200)},
    "w11_distances": {"dist_52w_high": f"close / {full('max({})', 'close', 250)} - 1", "dist_52w_low": f"close / {full('min({})', 'close', 250)} - 1", "drawdown_60": f"close / {full('max({})', 'close', 60)} - 1"},
    "w12_rsi_14": {"rsi_14": f"100 * {avg('up', 14)} / nullif({avg('up', 14)} + {avg('down', 14)}, 0)"},
    "w13_up_share_10": {"up_share_10": avg("CAST(lr > 0 AS DOUBLE)", 10)},
    "w14_log_value_20": {"log_value_20": f"ln({full('quantile_cont({}, 0.5)', 'value_inr', 20)})"},
    "w15_value_ratios": {"value_ratio_5_20": f"{avg('value_inr', 5)} / {avg('value_inr', 20)}", "value_ratio_1_60": f"value_inr / {avg('value_inr', 60)}"},
    "w16_log_amihud_20": {"log_amihud_20": f"ln(1 + {avg('abs(lr) / value_inr * 1e9', 20)})"},
    "w17_levels": {"log_price": "ln(close)", "delivery_5": avg("delivery_pct", 5), "delivery_20": avg("delivery_pct", 20), "delivery_ratio_5_20": f"{avg('delivery_pct', 5)} / nullif({avg('delivery_pct', 20)}, 0)", "is_t2t": "CAST(series IN ('BE', 'BZ') AS INT)"},
    "w18_sessions_since_break": {"sessions_since_break": "least(row_number() OVER (PARTITION BY company_id, segment ORDER BY trade_date) - 1, 500)"},
    "w19_beta_60": {"beta_60": BETA},
    "w20_idio_vol_60": {"idio_vol_60": f"CASE WHEN {BETA} IS NOT NULL THEN sqrt(greatest({_b60('var_samp', 'lr')} - pow({BETA}, 2) * {_b60('var_samp', 'mlr')}, 0)) END"},
    "w21_relative_returns": {"rel_ret_20": f"close / {LAG.format(20)} - 1 - m20", "rel_ret_60": f"close / {LAG.format(60)} - 1 - m60"},
}
INTEGERS = {"is_t2t", "sessions_since_break"}
for name, columns in FEATURES.items():
    picks = ", ".join(f"{x} AS {c}" if c in INTEGERS else f"round({x}, 6) AS {c}" for c, x in columns.items())
    register(name, lambda s, d, c=tuple(columns): rounded(features(s, d), *c), BASE + f"SELECT company_id, trade_date, {picks} FROM base LEFT JOIN mkt USING (trade_date)")


def w02(spark, d):
    p = fx.panel(spark, d)
    return p.select(*KEYS, F.round(F.ln(F.try_divide("close", F.lag("close").over(Window.partitionBy("company_id", "segment").orderBy("trade_date")))), 6).alias("lr"))


register("w02_log_return", w02, BASE + "SELECT company_id, trade_date, round(lr, 6) AS lr FROM base")
MKT = """SELECT trade_date, round(nifty500 / lag(nifty500, 5) OVER w - 1, 6) AS mkt_ret_5, round(nifty500 / lag(nifty500, 20) OVER w - 1, 6) AS mkt_ret_20, round(nifty500 / lag(nifty500, 60) OVER w - 1, 6) AS mkt_ret_60,
round(nifty500 / CASE WHEN count(nifty500) OVER (w ROWS 199 PRECEDING) = 200 THEN avg(nifty500) OVER (w ROWS 199 PRECEDING) END - 1, 6) AS mkt_sma_gap_200, round(vix, 6) AS vix, round(vix / nullif(lag(vix, 5) OVER w, 0) - 1, 6) AS vix_change_5
FROM market WINDOW w AS (ORDER BY trade_date)"""
MKT = MKT.replace("(w ROWS 199 PRECEDING)", "(ORDER BY trade_date ROWS 199 PRECEDING)")
register("w22_market_features", lambda s, d: rounded(ft.market_features(fx.market(s, d)), "mkt_ret_5", "mkt_ret_20", "mkt_ret_60", "mkt_sma_gap_200", "vix", "vix_change_5", keys=["trade_date"]), with_views("market") + MKT)
W23 = """, v AS (SELECT trade_date, vix, list(vix) OVER (ORDER BY trade_date ROWS 249 PRECEDING) AS l FROM market)
SELECT trade_date, round(CASE WHEN vix IS NOT NULL AND len(list_filter(l, lambda x: x IS NOT NULL)) = 250 THEN len(list_filter(l, lambda x: x < vix)) / 249.0 END, 6) AS vix_pct_250 FROM v"""
register("w23_vix_pct_250", lambda s, d: rounded(ft.market_features(fx.market(s, d)), "vix_pct_250", keys=["trade_date"]), with_views("market") + W23)
RANKS = {"rank_ret_5": "ret_5", "rank_ret_20": "ret_20", "rank_vol_20": "vol_20", "rank_value_20": "log_value_20", "rank_delivery_20": "delivery_20"}
RANKED = {"ret_5": f"close / {LAG.format(5)} - 1", "ret_20": f"close / {LAG.format(20)} - 1", "vol_20": full("stddev_samp({})", "lr", 20), "log_value_20": f"ln({full('quantile_cont({}, 0.5)', 'value_inr', 20)})", "delivery_20": avg("delivery_pct", 20)}


def w24(spark, d):
    f = features(spark, d).select(*KEYS, *[F.round(c, 9).alias(c) for c in RANKED])
    return rounded(ft.cross_section_ranks(f, RANKS), *RANKS)


_rank = "CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY trade_date ORDER BY {c} NULLS LAST) + (count(*) OVER (PARTITION BY trade_date, {c}) - 1) / 2.0) / count({c}) OVER (PARTITION BY trade_date) END"
register("w24_ranks", w24, BASE + ", f AS (SELECT company_id, trade_date, " + ", ".join(f"round({x}, 9) AS {c}" for c, x in RANKED.items()) + " FROM base) SELECT company_id, trade_date, " + ", ".join(f"round({_rank.format(c=c)}, 6) AS {n}" for n, c in RANKS.items()) + " FROM f")


def label_sql(gain=0.1, crash=0.1, window=5, name="panel"):
    w = "(PARTITION BY company_id, segment ORDER BY trade_date ROWS BETWEEN 1 FOLLOWING AND {} FOLLOWING)".format(window)
    s = "(PARTITION BY company_id, segment ORDER BY trade_date)"
    return f"""SELECT company_id, segment, trade_date, round(g, 6) AS max_gain_{window}, g >= {gain} AS label_a, l <= -{crash} AS label_c FROM (
SELECT company_id, segment, trade_date, CASE WHEN ok THEN top / entry - 1 END AS g, CASE WHEN ok THEN low / close - 1 END AS l FROM (
SELECT company_id, segment, trade_date, close, count(close) OVER {w} = {window} AND lead(trade_date, {window}) OVER {s} - trade_date <= {ft.label_span_days(window)} AS ok,
 max(close) OVER {w} AS top, min(close) OVER {w} AS low, lead(open) OVER {s} AS entry FROM {name}) x) y"""


LABELS = ["company_id", "segment", "trade_date"]
register("w25_labels", lambda s, d: rounded(ft.compute_labels(fx.panel(s, d)), "max_gain_5", "label_a", "label_c", keys=LABELS), with_views("panel") + label_sql())
register("c25_compute_labels", lambda s, d: rounded(ft.compute_labels(fx.panel(s, d), 0.2, 0.15, 10), "max_gain_10", "label_a", "label_c", keys=LABELS), with_views("panel") + label_sql(0.2, 0.15, 10))
register("a13_breadth", lambda s, d: ft.breadth(features(s, d)).select("trade_date", F.round("breadth", 6).alias("breadth")), BASE + f", f AS (SELECT trade_date, close / {avg('close', 50)} - 1 AS g FROM base) SELECT trade_date, round(avg(CAST(g > 0 AS DOUBLE)), 6) AS breadth FROM f GROUP BY trade_date")
ALL = {c: x for f in FEATURES.values() for c, x in f.items()}
register("c23_compute_features", lambda s, d: rounded(features(s, d), *ALL), BASE + "SELECT company_id, trade_date, " + ", ".join(f"{x} AS {c}" if c in INTEGERS else f"round({x}, 6) AS {c}" for c, x in ALL.items()) + " FROM base LEFT JOIN mkt USING (trade_date)")
register("c24_market_features", lambda s, d: rounded(ft.market_features(fx.market(s, d)), "mkt_ret_5", "mkt_ret_20", "mkt_ret_60", "mkt_sma_gap_200", "vix_change_5", "vix_pct_250", keys=["trade_date"]), with_views("market") + f", a AS ({MKT}), b AS (" + W23.lstrip(", ").replace("v AS (", "SELECT trade_date, vix_pct_250 FROM (WITH v AS (", 1) + ")) SELECT trade_date, mkt_ret_5, mkt_ret_20, mkt_ret_60, mkt_sma_gap_200, vix_change_5, vix_pct_250 FROM a JOIN b USING (trade_date)")
register("c26_cross_section_ranks", lambda s, d: ft.cross_section_ranks(fx.bars(s, d).select(*KEYS, "volume"), {"rank_volume": "volume"}).select(*KEYS, F.round("rank_volume", 6).alias("rank_volume")), with_views("bars") + "SELECT company_id, trade_date, round(" + _rank.format(c="volume") + ", 6) AS rank_volume FROM bars")


# other windows: W26-W37
def w26(s, d):
    w = Window.partitionBy("company_id").orderBy(F.col("ex_date").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return fx.factors(s, d).select("company_id", "ex_date", F.round(F.product("price_factor").over(w), 9).alias("cum_factor"))


register("w26_cumulative_factor", w26, with_views("factors") + "SELECT company_id, ex_date, round(exp(sum(ln(price_factor)) OVER (PARTITION BY company_id ORDER BY ex_date DESC)), 9) AS cum_factor FROM factors")
BY = lambda: Window.partitionBy("company_id").orderBy("trade_date")
register("w27_lag_trio", lambda s, d: fx.bars(s, d).select(*KEYS, F.lag("close").over(BY()).alias("prev_close"), F.lag("open").over(BY()).alias("prev_open"), F.datediff("trade_date", F.lag("trade_date").over(BY())).alias("gap_days")), with_views("bars") + "SELECT company_id, trade_date, lag(close) OVER w AS prev_close, lag(open) OVER w AS prev_open, CAST(trade_date - lag(trade_date) OVER w AS INT) AS gap_days FROM bars WINDOW w AS (PARTITION BY company_id ORDER BY trade_date)")


def w28(s, d):
    p = fx.px(s, d)
    prefer = F.when(F.col("l_linestatus") == "O", 1).when(F.col("l_linestatus") == "F", 2).otherwise(3)
    w = Window.partitionBy(*KEYS).orderBy(prefer, *fx.ORDER)
    return p.withColumn("rn", F.row_number().over(w)).where("rn = 1").select(*KEYS, "l_linestatus", "px")


register("w28_preferred_row", w28, with_views("px") + "SELECT company_id, trade_date, l_linestatus, px FROM px QUALIFY row_number() OVER (PARTITION BY company_id, trade_date ORDER BY CASE l_linestatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 3 END, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) = 1")


def top_k(df, by, k, *order):
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


register("w29_top_n", lambda s, d: top_k(fx.scored(s, d), "trade_date", 5, F.desc("p"), F.asc("row_id")).select("trade_date", "row_id", "p", "rank"), with_views("scored") + "SELECT trade_date, row_id, p, rank FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY p DESC, row_id) AS rank FROM scored) x WHERE rank <= 5")
register("w30_session_ordinal", lambda s, d: fx.bars(s, d).select("trade_date").distinct().withColumn("n", F.row_number().over(Window.orderBy("trade_date")).cast("long")), with_views("bars") + "SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS n FROM (SELECT DISTINCT trade_date FROM bars) x")


def latest_attempts(df, keys=("source_id", "partition_key")):
    w = Window.partitionBy(*keys).orderBy(F.desc("started_at"), F.desc("job_run_id"))
    return df.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


LATEST = with_views("attempts") + ", latest AS (SELECT * FROM attempts QUALIFY row_number() OVER (PARTITION BY source_id, partition_key ORDER BY started_at DESC, job_run_id DESC) = 1)\n"
register("w31_latest_attempt", lambda s, d: latest_attempts(fx.attempts(s, d)).select("source_id", "partition_key", "job_run_id", "status"), LATEST + "SELECT source_id, partition_key, job_run_id, status FROM latest")
REACH = lambda: Window.partitionBy("company_id").orderBy("trade_date")
register("w32_reach_rate", lambda s, d: fx.bars(s, d).select("company_id", (F.try_divide("close", F.lag("close", 21).over(REACH())) - 1).alias("r")).groupBy("company_id").agg(F.round(F.avg((F.col("r") >= 0.1).cast("double")), 6).alias("reach_rate")), with_views("bars") + "SELECT company_id, round(avg(CAST(r >= 0.1 AS DOUBLE)), 6) AS reach_rate FROM (SELECT company_id, close / lag(close, 21) OVER (PARTITION BY company_id ORDER BY trade_date) - 1 AS r FROM bars) x GROUP BY company_id")
PEAK = lambda: REACH().rowsBetween(Window.unboundedPreceding, 0)
register("w33_drawdown", lambda s, d: fx.bars(s, d).select(*KEYS, F.round(F.col("close") / F.max("close").over(PEAK()) - 1, 6).alias("drawdown"), F.round(F.col("close") / F.max("close").over(REACH().rowsBetween(-125, 0)) - 1, 6).alias("drawdown_126")), with_views("bars") + "SELECT company_id, trade_date, round(close / max(close) OVER (PARTITION BY company_id ORDER BY trade_date) - 1, 6) AS drawdown, round(close / max(close) OVER (PARTITION BY company_id ORDER BY trade_date ROWS 125 PRECEDING) - 1, 6) AS drawdown_126 FROM bars")


def w34(s, d):
    prev = F.lag("value_inr").over(REACH())
    growth = F.coalesce((F.col("value_inr") - F.col("volume")) / prev, F.lit(1.0))
    b = fx.bars(s, d).select(*KEYS, F.ln(growth).alias("g"))
    return b.select(*KEYS, F.round(F.sum("g").over(PEAK()), 6).alias("log_index"))


register("w34_time_weighted_index", w34, with_views("bars") + "SELECT company_id, trade_date, round(sum(g) OVER (PARTITION BY company_id ORDER BY trade_date), 6) AS log_index FROM (SELECT company_id, trade_date, ln(coalesce((value_inr - volume) / lag(value_inr) OVER (PARTITION BY company_id ORDER BY trade_date), 1)) AS g FROM bars) x")


def yearly_returns(daily, value="close"):
    y = daily.groupBy("company_id", F.year("trade_date").cast("int").alias("year")).agg(F.max_by(value, "trade_date").alias("end"))
    before = F.lag("end", 1).over(Window.partitionBy("company_id").orderBy("year"))
    return y.select("company_id", "year", F.round(F.col("end") / F.coalesce(before, F.lit(1.0)) - 1, 6).alias("ret"))


register("w35_calendar_year_return", lambda s, d: yearly_returns(fx.bars(s, d)), with_views("bars") + "SELECT company_id, CAST(y AS INT) AS year, round(e / coalesce(lag(e) OVER (PARTITION BY company_id ORDER BY y), 1.0) - 1, 6) AS ret FROM (SELECT company_id, year(trade_date) AS y, max_by(close, trade_date) AS e FROM bars GROUP BY 1, 2) x")


def w36(s, d):
    first = fx.txns(s, d).where("side = 'BUY'").groupBy("account", "company_id").agg(F.min("trade_date").alias("bought"))
    return mn.peaks_since(first, fx.bars(s, d)).select("account", "company_id", F.round("peak_close", 6).alias("peak"), "sessions_held")


register("w36_peak_since_buy", w36, with_views("txns", "bars") + ", f AS (SELECT account, company_id, min(trade_date) AS bought FROM txns WHERE side = 'BUY' GROUP BY 1, 2) SELECT account, f.company_id, round(max(close), 6) AS peak, count(*) AS sessions_held FROM f JOIN bars b ON b.company_id = f.company_id AND b.trade_date >= bought GROUP BY 1, 2")


def w37(s, d):
    """Every company on every session: a company's missing sessions are exploded from the list of all, which its first row carries."""
    b = fx.bars(s, d).select(*KEYS, "close")
    all_days = b.agg(F.array_sort(F.collect_set("trade_date")).alias("days"))  # one row, a date for each session
    grid = b.groupBy("company_id").agg(F.min("trade_date").alias("first")).join(F.broadcast(all_days)).select("company_id", F.explode("days").alias("trade_date"))
    return grid.join(b, KEYS, "left").select(*KEYS, F.last("close", ignorenulls=True).over(PEAK()).alias("close"))


register("w37_carry_forward", w37, with_views("bars") + "SELECT company_id, trade_date, last_value(close IGNORE NULLS) OVER (PARTITION BY company_id ORDER BY trade_date) AS close FROM (SELECT c.company_id, t.trade_date, b.close FROM (SELECT DISTINCT company_id FROM bars) c CROSS JOIN (SELECT DISTINCT trade_date FROM bars) t LEFT JOIN bars b ON b.company_id = c.company_id AND b.trade_date = t.trade_date) g")


def weekly_top5(spark, d):
    p = features(spark, d).join(ft.weekly_dates(fx.panel(spark, d)).select("trade_date"), "trade_date", "left_semi").where("vol_20 is not null")
    p = p.select(*KEYS, F.round("ret_5", 6).alias("ret_5"), F.round("vol_20", 6).alias("vol_20"), F.round("sma_gap_20", 6).alias("sma_gap_20"))
    return top_k(p, "trade_date", 5, F.desc("vol_20"), F.asc("company_id"))


register("l03_weekly_top5", weekly_top5, BASE + f""", f AS (SELECT company_id, trade_date, round(close / {LAG.format(5)} - 1, 6) AS ret_5, round({full('stddev_samp({})', 'lr', 20)}, 6) AS vol_20, round(close / {avg('close', 20)} - 1, 6) AS sma_gap_20 FROM base),
w AS (SELECT max(trade_date) AS trade_date FROM panel GROUP BY date_trunc('week', trade_date))
SELECT * FROM (SELECT f.*, row_number() OVER (PARTITION BY trade_date ORDER BY vol_20 DESC, company_id) AS rank FROM f SEMI JOIN w USING (trade_date) WHERE vol_20 IS NOT NULL) x WHERE rank <= 5""")
