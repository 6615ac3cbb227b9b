"""Point-in-time features, labels and weekly samples over a daily panel.

All rolling features share one partitioning (company, segment), so a panel is shuffled once for them;
ranks shuffle once more by date. Levels enter only through ratios, so a later adjustment cannot change
an earlier feature.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import average_rank, finite, last_rows, median, ordered, ratio, rolling
from .intervals import asof_join, overlapping

#: Days ahead beyond which the nearest results date no longer tells.
AHEAD = 45
RETURNS = (1, 3, 5, 10, 20, 60, 120, 250)


def label_span_days(window: int) -> int:
    """Calendar days that `window` sessions may span before a label counts as stretched."""
    return max(14, math.ceil(14 * window / 5))


def market_features(market: DataFrame) -> DataFrame:
    """Features of the market series; one row a session, hence one partition."""
    w = Window.orderBy("trade_date")
    c = F.col("nifty500")
    roll = lambda agg, x, k: rolling(agg, x, k, keys=())
    year = w.rowsBetween(-249, 0)
    seen = F.collect_list("vix").over(year)
    vix_pct = F.when(F.count("vix").over(year) == 250, F.size(F.filter(seen, lambda x: x < F.element_at(seen, -1))) / 249)
    # the element the filter compares with is the current one only if it is there
    out = market.select("trade_date", c, "vix", *[ratio(c, F.lag(c, k).over(w)).alias(f"_r{k}") for k in (5, 20, 60)], ratio(c, F.lag(c).over(w)).alias("_r1"), ratio(c, roll(F.avg, c, 200)).alias("_sma"), F.lag("vix", 5).over(w).alias("_v5"), F.when(F.col("vix").isNotNull(), vix_pct).alias("vix_pct_250"))
    return out.select("trade_date", *[(F.col(f"_r{k}") - 1).alias(f"mkt_ret_{k}") for k in (5, 20, 60)], (F.col("_sma") - 1).alias("mkt_sma_gap_200"), "vix", (ratio(F.col("vix"), F.col("_v5")) - 1).alias("vix_change_5"), "vix_pct_250", F.ln("_r1").alias("mkt_lr"))


def compute_features(panel: DataFrame, market: DataFrame) -> DataFrame:
    """Adds the rolling features; `market` is the result of `market_features`."""
    w = ordered()
    c, v = F.col("close"), F.col("value_inr")
    m = market.select("trade_date", "mkt_lr", *[F.col(f"mkt_ret_{k}") for k in (20, 60)])
    before = F.lag("close").over(w)
    p = panel.join(m, "trade_date", "left").withColumns({
        "_lr": F.ln(ratio(c, before)), "_prev": before, "_tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)),
        "_hl": F.pow(F.ln(ratio(F.col("high"), F.col("low"))), F.lit(2)), "_gap": (F.abs(ratio(F.col("open"), before) - 1) > 0.02).cast("double"), "_up": F.when(c > before, c - before).when(before.isNotNull(), 0.0), "_down": F.when(c < before, before - c).when(before.isNotNull(), 0.0),
    })
    lr, mk = F.col("_lr"), F.col("mkt_lr")
    both = lambda x: F.when(lr.isNotNull() & mk.isNotNull(), x)
    n60 = F.count(both(lr)).over(last_rows(60))
    var_m = F.when(n60 == 60, F.var_samp(both(mk)).over(last_rows(60)))
    cov = F.when(n60 == 60, F.avg(both(lr * mk)).over(last_rows(60)) - F.avg(both(lr)).over(last_rows(60)) * F.avg(both(mk)).over(last_rows(60)))
    beta = ratio(cov, var_m)
    up, down = rolling(F.avg, F.col("_up"), 14), rolling(F.avg, F.col("_down"), 14)
    new: dict[str, Column] = {f"ret_{k}": ratio(c, F.lag("close", k).over(w)) - 1 for k in RETURNS}
    new |= {f"vol_{k}": rolling(F.stddev_samp, lr, k) for k in (5, 20, 60)}
    new |= {f"sma_gap_{k}": ratio(c, rolling(F.avg, c, k)) - 1 for k in (20, 50, 200)}
    new |= {
        "atr_14_pct": ratio(rolling(F.avg, F.col("_tr"), 14), c), "hl_vol_20": F.sqrt(rolling(F.avg, F.col("_hl"), 20) / (4 * math.log(2))), "max_abs_move_20": rolling(F.max, F.abs(lr), 20),
        "big_move_count_60": rolling(F.sum, (F.abs(lr) > math.log(1.05)).cast("double"), 60), "gap_freq_20": rolling(F.avg, F.col("_gap"), 20),
        "dist_52w_high": ratio(c, rolling(F.max, c, 250)) - 1, "dist_52w_low": ratio(c, rolling(F.min, c, 250)) - 1, "drawdown_60": ratio(c, rolling(F.max, c, 60)) - 1,
        "rsi_14": 100 * ratio(up, up + down), "up_share_10": rolling(F.avg, (lr > 0).cast("double"), 10), "log_value_20": F.ln(rolling(median, v, 20)),
        "value_ratio_5_20": ratio(rolling(F.avg, v, 5), rolling(F.avg, v, 20)), "value_ratio_1_60": ratio(v, rolling(F.avg, v, 60)), "log_amihud_20": F.log1p(rolling(F.avg, ratio(F.abs(lr), v) * 1e9, 20)),
        "log_price": F.ln(c), "delivery_5": rolling(F.avg, F.col("delivery_pct"), 5), "delivery_20": rolling(F.avg, F.col("delivery_pct"), 20), "is_t2t": F.col("series").isin("BE", "BZ").cast("int"),
        "sessions_since_break": F.least(F.row_number().over(w) - 1, F.lit(500)).cast("long"), "beta_60": beta, "_var_lr": F.when(n60 == 60, F.var_samp(both(lr)).over(last_rows(60))), "_var_m": var_m,
    }
    p = p.select("*", *[x.alias(k) for k, x in new.items()])
    rest = F.col("_var_lr") - F.pow("beta_60", F.lit(2)) * F.col("_var_m")
    p = p.withColumns({
        "vol_ratio_5_60": ratio(F.col("vol_5"), F.col("vol_60")), "delivery_ratio_5_20": ratio(F.col("delivery_5"), F.col("delivery_20")), "idio_vol_60": F.when(rest.isNotNull(), F.sqrt(F.greatest(rest, F.lit(0.0)))),
        "rel_ret_20": F.col("ret_20") - F.col("mkt_ret_20"), "rel_ret_60": F.col("ret_60") - F.col("mkt_ret_60"),
    })
    return p.select(*[finite(F.col(f.name)).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in p.schema if not f.name.startswith("_")])


def breadth(features: DataFrame) -> DataFrame:
    """Share of companies above their 50-session mean, by date; those without one don't count."""
    return features.groupBy("trade_date").agg(F.avg(F.when(F.col("sma_gap_50").isNotNull(), (F.col("sma_gap_50") > 0).cast("double"))).alias("breadth"))


def compute_labels(panel: DataFrame, gain: float = 0.1, crash: float = 0.1, window: int = 5) -> DataFrame:
    """Forward labels: label_a (a close reaches the gain over the next open), label_c (a close falls by the crash
    from today's), max_gain. Null at the end of a segment and where the sessions span too many days."""
    w = ordered()
    ahead = w.rowsBetween(1, window)
    ok = (F.count("close").over(ahead) == window) & (F.datediff(F.lead("trade_date", window).over(w), F.col("trade_date")) <= label_span_days(window))
    entry = F.lead("open").over(w)
    top = ratio(F.max("close").over(ahead), entry) - 1
    low = ratio(F.min("close").over(ahead), F.col("close")) - 1
    out = panel.select("company_id", "segment", "trade_date", F.when(ok, top).alias(f"max_gain_{window}"), F.when(ok, low).alias("_low"))
    return out.select("company_id", "segment", "trade_date", f"max_gain_{window}", (F.col(f"max_gain_{window}") >= gain).alias("label_a"), (F.col("_low") <= -crash).alias("label_c"))


def cross_section_ranks(samples: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds average-rank percentiles within each date: {new name: column}."""
    return samples.select("*", *[average_rank(c).alias(n) for n, c in columns.items()])


def weekly_dates(panel: DataFrame) -> DataFrame:
    """The last session of each Monday week."""
    return panel.groupBy(F.date_trunc("week", "trade_date").cast("date").alias("week")).agg(F.max("trade_date").alias("trade_date"))


def event_features(samples: DataFrame, meetings: DataFrame, filings: DataFrame, closes: DataFrame) -> DataFrame:
    """What is known of results at 20:00 of each sample's date: days since the last ones, days to the next
    announced ones, whether they fall into the coming week, and how the price reacted last time."""
    at = F.col("trade_date").cast("timestamp_ntz") + F.expr("INTERVAL '20' HOUR")
    s = samples.select("company_id", "trade_date", at.alias("at"))
    first = filings.groupBy("company_id", "period_to").agg(F.min("published_at").alias("published_at"))
    since = asof_join(s, first, "company_id", "at", "published_at", ["period_to"])
    since = since.select("company_id", "trade_date", F.least(F.datediff("trade_date", F.col("matched_published_at").cast("date")), F.lit(200)).alias("days_since_results"))
    # meetings known by then and still to come: each is told to the days of its last weeks, where the nearest one
    # counts; further ahead it only matters that there is one, which a running count of known meetings tells
    known = F.col("announced_at").cast("timestamp_ntz")
    told = F.when(F.date_format(known, "HH:mm:ss.SSSSSS") <= "20:00:00.000000", known.cast("date")).otherwise(F.date_add(known.cast("date"), 1))
    m = meetings.where("is_results").select("company_id", "meeting_date", told.alias("told")).where("told < meeting_date")
    near = m.select("company_id", "meeting_date", F.explode(F.sequence(F.greatest(F.col("told"), F.date_sub("meeting_date", AHEAD)), F.date_sub("meeting_date", 1))).alias("trade_date"))
    near = near.groupBy("company_id", "trade_date").agg(F.min(F.datediff("meeting_date", "trade_date")).alias("near"))
    steps = m.select("company_id", F.explode(F.array(F.struct(F.col("told").alias("trade_date"), F.lit(1).alias("step")), F.struct(F.col("meeting_date").alias("trade_date"), F.lit(-1).alias("step")))).alias("x")).select("company_id", "x.*", F.lit(False).alias("own"))
    upto = Window.partitionBy("company_id").orderBy("trade_date", "own").rowsBetween(Window.unboundedPreceding, 0)
    both = steps.unionByName(samples.select("company_id", "trade_date", F.lit(0).alias("step"), F.lit(True).alias("own"))).withColumn("open", F.sum("step").over(upto))
    ahead = both.where("own").select("company_id", "trade_date", "open").distinct().join(near, ["company_id", "trade_date"], "left")
    ahead = ahead.select("company_id", "trade_date", F.when(F.col("open") > 0, F.least(F.coalesce("near", F.lit(AHEAD)), F.lit(AHEAD))).alias("results_ahead_days"))
    # the session that can first react: the same day up to 15:30, else the next one
    day = F.when(F.date_format("published_at", "HH:mm:ss") <= "15:30:00", F.col("published_at").cast("date")).otherwise(F.date_add(F.col("published_at").cast("date"), 1))
    w = Window.partitionBy("company_id").orderBy("trade_date")
    moves = closes.select("company_id", F.col("trade_date").alias("session"), (ratio(F.col("close"), F.lag("close").over(w)) - 1).alias("move"))
    react = asof_join(first.select("company_id", day.alias("day")), moves, "company_id", "day", "session", ["move", "session"], "forward").where("session is not null")
    reaction = asof_join(samples.select("company_id", "trade_date"), react.select("company_id", F.col("session").alias("reacted"), "move"), "company_id", "trade_date", "reacted", ["move"])
    keys = ["company_id", "trade_date"]
    out = samples.join(since, keys, "left").join(ahead, keys, "left").join(reaction.select(*keys, F.col("move").alias("last_results_reaction")), keys, "left")
    return out.withColumn("results_this_week", F.coalesce(F.col("results_ahead_days") <= 7, F.lit(False)))


def blocked_samples(samples: DataFrame, flags: DataFrame, days: int) -> DataFrame:
    """Samples with `blocked`: a BLOCK flag meets the days that their label looks at."""
    hit = overlapping(samples, flags.where("severity = 'BLOCK'"), "company_id", "trade_date", days).withColumn("blocked", F.lit(True))
    return samples.join(hit, ["company_id", "trade_date"], "left").withColumn("blocked", F.coalesce("blocked", F.lit(False)))


def weekly_samples(panel: DataFrame, market: DataFrame, members: DataFrame, meetings: DataFrame, filings: DataFrame, flags: DataFrame, gain: float = 0.1, crash: float = 0.1, window: int = 5, version: str = "1") -> DataFrame:
    """Members' features, labels, ranks, event features and blocks on the last session of each week."""
    mkt = market_features(market)
    f = compute_features(panel, mkt).drop("mkt_lr", "mkt_ret_20", "mkt_ret_60")
    f = f.join(weekly_dates(panel).select("trade_date"), "trade_date", "left_semi").withColumn("month", F.date_format("trade_date", "yyyy-MM"))
    f = f.join(members.select("company_id", "month"), ["company_id", "month"], "left_semi")
    f = f.join(compute_labels(panel, gain, crash, window), ["company_id", "segment", "trade_date"], "left")
    f = f.join(mkt.drop("mkt_lr"), "trade_date", "left").join(breadth(f), "trade_date", "left")
    f = cross_section_ranks(f, {"rank_ret_5": "ret_5", "rank_ret_20": "ret_20", "rank_vol_20": "vol_20", "rank_value_20": "log_value_20", "rank_delivery_20": "delivery_20"})
    f = event_features(f, meetings, filings, panel.select("company_id", "trade_date", "close"))
    return blocked_samples(f, flags, label_span_days(window)).withColumn("feature_version", F.lit(version))


def horizon_samples(saved: DataFrame, panel: DataFrame, gain: float, window: int) -> DataFrame:
    """Saved samples with labels for another gain and window."""
    old = [c for c in saved.columns if c in ("label_a", "label_c") or c.startswith("max_gain_")]
    return saved.drop(*old).join(compute_labels(panel, gain, gain, window), ["company_id", "segment", "trade_date"], "left")
