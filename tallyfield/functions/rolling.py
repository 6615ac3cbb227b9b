"""Rolling expressions that stay null until their window is full of values."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

PANEL = ("company_id", "segment")


def ordered(keys=PANEL, time: str = "trade_date"):
    return Window.partitionBy(*keys).orderBy(time)


def last_rows(k: int, keys=PANEL, time: str = "trade_date"):
    return ordered(keys, time).rowsBetween(-(k - 1), 0)


def rolling(agg, x: Column, k: int, keys=PANEL, time: str = "trade_date") -> Column:
    """agg(x) over the last k rows; null unless all k values are there."""
    w = last_rows(k, keys, time)
    return F.when(F.count(x).over(w) == k, agg(x).over(w))


def median(x: Column) -> Column:
    return F.percentile(x, F.lit(0.5))


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0."""
    return F.try_divide(a, b)


def finite(x: Column) -> Column:
    return F.when(F.abs(x) != F.lit(float("inf")), x)


def average_rank(x: str, by: str = "trade_date") -> Column:
    """Average rank over count within `by`; nulls are neither ranked nor counted."""
    w = Window.partitionBy(by).orderBy(F.col(x).asc_nulls_last())
    ties = F.count("*").over(Window.partitionBy(by, x))
    return F.when(F.col(x).isNotNull(), (F.rank().over(w) + (ties - 1) / 2) / F.count(x).over(Window.partitionBy(by)))
