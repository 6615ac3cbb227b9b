"""Everyday relational operators: aggregates, set operations, limits and predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: how many nulls each column has."""
    return df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(f"{c}_nulls") for c in columns])


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def top_per_group(df: DataFrame, by: list[str], k: int, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def keep_last(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return top_per_group(df, keys, 1, *order).drop("rank")


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """x held within the bounds; null stays null."""
    y = x
    if low is not None:
        y = F.greatest(y, F.lit(low))
    if high is not None:
        y = F.least(y, F.lit(high))
    return F.when(x.isNotNull(), y)


def infinite_to_null(df: DataFrame) -> DataFrame:
    """Infinite doubles become null; NaN stays."""
    return df.select(*[F.when(F.abs(c) != float("inf"), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def union_all(frames: list[DataFrame], missing: bool = False) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=missing), frames)


def relaxed_union(a: DataFrame, b: DataFrame, types: dict[str, str]) -> DataFrame:
    """Union by name after casting both sides to the given types."""
    cast = lambda df: df.select(*[F.col(c).cast(t).alias(c) for c, t in types.items()])
    return cast(a).unionByName(cast(b))


def changed_keys(old: DataFrame, new: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """(key, old, new) of keys added, removed or changed."""
    a = old.select(F.col(key), F.col(value).alias("old"))
    b = new.select(F.col(key).alias("__k"), F.col(value).alias("new"))
    out = a.join(b, F.col(key) == F.col("__k"), "full_outer")
    return out.where(~F.col("old").eqNullSafe(F.col("new"))).select(F.coalesce(key, "__k").alias(key), "old", "new")


def strict_cast(df: DataFrame, types: dict[str, str], trim: bool = True) -> DataFrame:
    """Cast text columns; a value that does not parse raises (ANSI)."""
    value = lambda c: F.trim(c) if trim else F.col(c)
    return df.select(*[value(c).cast(t).alias(c) for c, t in types.items()], *[c for c in df.columns if c not in types])


def split_bad_rows(df: DataFrame, types: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(rows whose texts all parse, cast; rows where one does not, as they came)."""
    bad = reduce(lambda a, b: a | b, [F.col(c).isNotNull() & F.trim(c).try_cast(t).isNull() for c, t in types.items()])
    good = df.where(~bad)
    return good.select(*[F.trim(c).try_cast(t).alias(c) if (t := types.get(c)) else F.col(c) for c in df.columns]), df.where(bad)


def ohlc_broken(eps: float = 1e-6) -> Column:
    """Prices that aren't positive, out of order, or a negative volume."""
    c = F.col
    order = (c("high") < c("low") - eps) | (F.greatest("open", "close") > c("high") + eps) | (F.least("open", "close") < c("low") - eps)
    return (F.least("open", "high", "low", "close") <= 0) | order | (c("volume") < 0)


def ohlc_violations(bars: DataFrame, eps: float = 1e-6) -> DataFrame:
    return bars.where(ohlc_broken(eps))


#: Split ratios that a raw move is compared with.
SPLIT_RATIOS = (1 / 2, 1 / 3, 1 / 4, 1 / 5, 1 / 10, 2 / 5)


def looks_like_split(raw: Column, prior: Column, gap_days: Column) -> Column:
    nearest = F.array_min(F.transform(F.array(*[F.lit(r) for r in SPLIT_RATIOS]), lambda r: F.abs(raw - r) / r))
    return (raw <= 0.55) & (prior >= 10) & (gap_days <= 10) & (nearest <= 0.03)


def stress(market_gap: Column, vix_pct: Column, cut: float = 0.8) -> Column:
    return F.coalesce((market_gap < 0) & (vix_pct >= cut), F.lit(False))


def eligible(candidates: DataFrame, held: DataFrame, min_sessions: int = 250) -> DataFrame:
    """Scored, unblocked, freely traded candidates with enough history that are not already held."""
    ok = F.col("score").isNotNull() & ~F.coalesce("blocked", F.lit(False)) & ~F.coalesce("is_t2t", F.lit(False)) & (F.col("sessions") >= min_sessions)
    return candidates.where(ok).join(held.select("company_id"), "company_id", "left_anti")
