"""Metrics and gates over scored predictions, without model code."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def wilson_lower(hits: Column, n: Column, z: float = Z95) -> Column:
    p = F.try_divide(hits, n)
    return F.when(n > 0, (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n))


#: Ranges of scores that a ranking is dealt to.
RANGES = 200


def running_counts(preds: DataFrame, score: str, label: str, by: list[str], ranges: int = RANGES) -> DataFrame:
    """(by, score, n, pos, n_below, pos_below): rows and positives of each distinct score, and of all smaller ones.

    Scores are dealt to ranges cut at their approximate quantiles, of which the driver sees the bounds only; null scores are the smallest. Within a range a window
    adds up; what lies in the ranges before is the sum of at most `ranges` totals. So no task sorts more than a range
    of a group.
    """
    known = preds.where(F.col(label).isNotNull())
    cuts = known.agg(F.percentile_approx(score, [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0]
    inf = float("inf")
    deal = Bucketizer(splits=[-inf, *(sorted({float(x) for x in cuts or [0.0]} - {inf, -inf}) or [0.0]), inf], inputCol="__score", outputCol="__range")
    per = known.groupBy(*by, score).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    per = deal.transform(per.withColumn("__score", F.coalesce(F.col(score).cast("double"), F.lit(-inf)))).drop("__score")
    inside = Window.partitionBy(*by, "__range").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    totals = per.groupBy(*by, "__range").agg(F.sum("n").alias("tn"), F.sum("pos").alias("tp"))
    other = totals.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__range").alias("__before"), F.col("tn").alias("on"), F.col("tp").alias("op"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    start = totals.join(other, same & (F.col("__before") < F.col("__range")), "left").groupBy(*by, "__range").agg(F.coalesce(F.sum("on"), F.lit(0)).alias("sn"), F.coalesce(F.sum("op"), F.lit(0)).alias("sp"))
    start = start.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__range").alias("__r"), "sn", "sp")
    below = lambda c, s: F.col(s) + F.coalesce(F.sum(c).over(inside), F.lit(0))
    out = per.join(start, same & (F.col("__range") == F.col("__r")))
    return out.select(*by, score, "n", "pos", below("n", "sn").alias("n_below"), below("pos", "sp").alias("pos_below"))


def auc(preds: DataFrame, by: list[str] | None = None, score: str = "p", label: str = "label") -> DataFrame:
    """Exact area under the curve by average ranks; null with one class only."""
    by = by or []
    per = running_counts(preds, score, label, by).withColumn("rank", F.col("n_below") + (F.col("n") + 1) / 2)
    out = per.groupBy(*by).agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("p1"), (F.sum("n") - F.sum("pos")).alias("p0"))
    return out.select(*by, F.try_divide(F.col("r") - F.col("p1") * (F.col("p1") + 1) / 2, F.col("p1") * F.col("p0")).alias("auc"))


def average_precision(preds: DataFrame, score: str = "p", label: str = "label", by: list[str] | None = None) -> DataFrame:
    """Precision at each distinct score, weighted by the positives found there."""
    by = by or []
    per = running_counts(preds, score, label, by)
    whole = per.groupBy(*by).agg(F.sum("n").alias("all_n"), F.sum("pos").alias("all_pos"))
    if by:
        keyed = whole.select(*[F.col(c).alias(f"__{c}") for c in by], "all_n", "all_pos")
        same = F.lit(True)
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
        per = per.join(keyed, same)
    else:
        per = per.crossJoin(F.broadcast(whole))  # one row
    precision = (F.col("all_pos") - F.col("pos_below")) / (F.col("all_n") - F.col("n_below"))
    return per.groupBy(*by).agg(F.try_divide(F.sum(precision * F.col("pos")), F.sum("pos")).alias("ap"))


def brier(preds: DataFrame) -> DataFrame:
    return preds.agg(F.avg(F.pow(F.col("p") - F.col("label").cast("double"), F.lit(2))).alias("brier"))


def calibration_table(preds: DataFrame, edges: tuple[float, ...], left_closed: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """Stated against observed rate by band of p; bands include their left edge, or else their right one."""
    band = F.lit(0)
    for e in edges:
        band = band + ((F.col("p") >= e) if left_closed else (F.col("p") > e)).cast("int")
    return preds.groupBy(*by, band.cast("long").alias("band")).agg(F.count("*").alias("n"), F.avg("p").alias("stated"), F.avg(F.col("label").cast("double")).alias("observed"))


def top_k_precision(preds: DataFrame, k: int = 5) -> DataFrame:
    w = Window.partitionBy("trade_date").orderBy(F.desc("p"), "row_id")
    top = preds.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
    return top.agg(F.avg(F.col("label").cast("double")).alias("top_k_precision"))


def cumulative_gate(preds: DataFrame) -> DataFrame:
    """(cutoff, n, hits, precision, lower) of every distinct probability, by one running sum from the top."""
    per = preds.where("label is not null").groupBy(F.round("p", 6).alias("cutoff")).agg(F.count("*").alias("k"), F.sum(F.col("label").cast("long")).alias("h"))
    w = Window.orderBy(F.desc("cutoff")).rowsBetween(Window.unboundedPreceding, 0)  # over distinct cutoffs
    out = per.select("cutoff", F.sum("k").over(w).alias("n"), F.sum("h").over(w).alias("hits"))
    return out.withColumns({"precision": F.col("hits") / F.col("n"), "lower": wilson_lower(F.col("hits"), F.col("n"))})


def shown(preds: DataFrame, cutoffs: DataFrame, per_week: int | None, rank_by: str = "p") -> DataFrame:
    """Predictions at or above each cutoff, at most `per_week` a date; cutoffs are a short list and broadcast."""
    j = F.broadcast(cutoffs).join(preds.where("label is not null"), F.col("p") >= F.col("cutoff"))
    if per_week is None:
        return j
    w = Window.partitionBy("cutoff", "trade_date").orderBy(F.desc(rank_by), "row_id")
    return j.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= per_week).drop("rn")


def precision_curve(preds: DataFrame, cutoffs: DataFrame, per_week: int | None = None) -> DataFrame:
    out = shown(preds, cutoffs, per_week).groupBy("cutoff").agg(F.count("*").alias("n"), F.sum(F.col("label").cast("long")).alias("hits"), F.countDistinct("trade_date").alias("weeks"))
    return out.withColumns({"precision": F.col("hits") / F.col("n"), "lower": wilson_lower(F.col("hits"), F.col("n"))})


def pick_gate(curve: DataFrame, precision: float = 0.9, signals: int = 30, lower: float = 0.8) -> DataFrame:
    """One row: the lowest cutoff that meets all three bars, LIVE, or OFF with null."""
    ok = (F.col("precision") >= precision) & (F.col("n") >= signals) & (F.col("lower") >= lower)
    out = curve.agg(F.min(F.when(ok, F.col("cutoff"))).alias("cutoff"), F.max(F.when(F.col("n") >= signals, F.col("precision"))).alias("best_precision"))
    return out.withColumn("status", F.when(F.col("cutoff").isNotNull(), "LIVE").otherwise("OFF"))


def dedupe_warnings(preds: DataFrame, days: int, keys: tuple[str, ...] = ("company_id",)) -> DataFrame:
    """Per key the warnings that come at least `days` after the last kept one (a fold over sorted dates)."""
    per = preds.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("trade_date", "label"))).alias("xs"))
    start = F.struct(F.lit(None).cast("date").alias("last"), F.expr("cast(array() as array<struct<trade_date:date,label:boolean>>)").alias("out"))
    keep = lambda s, x: F.when(s["last"].isNull() | (F.datediff(x["trade_date"], s["last"]) >= days), F.struct(x["trade_date"].alias("last"), F.array_append(s["out"], x).alias("out"))).otherwise(s)
    return per.select(*keys, F.explode(F.aggregate("xs", start, keep, lambda s: s["out"])).alias("w")).select(*keys, "w.*")


def judge_safety(preds: DataFrame, cutoffs: DataFrame, days: int = 28, bar: float = 0.8, lower: float = 0.7, signals: int = 30) -> DataFrame:
    """Per cutoff: deduplicated warnings, precision, bound, and the share of years that hold up."""
    w = dedupe_warnings(shown(preds, cutoffs, None), days, ("cutoff", "company_id"))
    year = w.groupBy("cutoff", F.year("trade_date").alias("y")).agg(F.count("*").alias("k"), F.avg(F.col("label").cast("double")).alias("p"))
    years = year.where("k >= 5").groupBy("cutoff").agg(F.count("*").alias("years"), F.count(F.when(F.col("p") >= bar - 0.1, 1)).alias("years_ok"))
    out = w.groupBy("cutoff").agg(F.count("*").alias("n"), F.sum(F.col("label").cast("long")).alias("hits")).join(years, "cutoff", "left").fillna(0, ["years", "years_ok"])
    out = out.withColumns({"precision": F.col("hits") / F.col("n"), "lower": wilson_lower(F.col("hits"), F.col("n"))})
    ok = (F.col("n") >= signals) & (F.col("precision") >= bar) & (F.col("lower") >= lower) & (F.col("years") > 0) & (F.col("years_ok") >= 0.6 * F.col("years"))
    return out.withColumn("ok", ok)


def safety_gate(judged: DataFrame, signals: int = 30) -> DataFrame:
    """One row of `judge_safety`: the lowest cutoff that passes, LIVE, or OFF with the most precise one.

    Cutoffs count from the lowest on, up to the first that leaves fewer than `signals` warnings.
    """
    stop = judged.agg(F.min(F.when(F.col("n") < signals, F.col("cutoff"))).alias("stop"))
    rows = judged.join(F.broadcast(stop), F.col("stop").isNull() | (F.col("cutoff") < F.col("stop")))  # one row
    live = F.min(F.when(F.col("ok"), F.col("cutoff")))
    best = F.max_by(F.struct("cutoff", "precision"), F.struct(F.col("precision"), -F.col("cutoff")))
    out = rows.agg(live.alias("cutoff"), best.alias("b"))
    return out.select(F.when(F.col("cutoff").isNotNull(), "LIVE").otherwise("OFF").alias("status"), "cutoff", F.col("b.cutoff").alias("best_cutoff"), F.col("b.precision").alias("best_precision"))


def compare_scores(preds: DataFrame, scores: list[str], per_week: int = 5, precision: float = 0.9, signals: int = 30, lower: float = 0.8) -> DataFrame:
    """Per score column over the same labels: AUC, top-k precision, the gate's best precision and its status."""
    known = preds.where("label is not null")
    long = known.select("row_id", "trade_date", "label", F.explode(F.array(*[F.struct(F.lit(s).alias("model"), F.col(s).alias("p")) for s in scores])).alias("x")).select("row_id", "trade_date", "label", "x.*")
    w = Window.partitionBy("model", "trade_date").orderBy(F.desc("p"), "row_id")
    top = long.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= per_week)
    best = top.groupBy("model").agg(F.avg(F.col("label").cast("double")).alias("top_k_precision"))
    per = top.groupBy("model", F.round("p", 6).alias("cutoff")).agg(F.count("*").alias("k"), F.sum(F.col("label").cast("long")).alias("h"))
    run = Window.partitionBy("model").orderBy(F.desc("cutoff")).rowsBetween(Window.unboundedPreceding, 0)  # over distinct cutoffs
    curve = per.select("model", "cutoff", F.sum("k").over(run).alias("n"), F.sum("h").over(run).alias("hits")).withColumn("precision", F.col("hits") / F.col("n"))
    ok = (F.col("precision") >= precision) & (F.col("n") >= signals) & (wilson_lower(F.col("hits"), F.col("n")) >= lower)
    gate = curve.groupBy("model").agg(F.max(F.when(F.col("n") >= signals, F.col("precision"))).alias("best_precision"), F.max(ok).alias("live"))
    out = auc(long, ["model"]).join(best, "model").join(gate, "model")
    return out.withColumn("gate", F.when(F.col("live"), "LIVE").otherwise("OFF")).drop("live")
