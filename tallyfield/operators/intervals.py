"""Joins on time: as-of, validity intervals, overlaps, segments and ordinal bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: list[str], direction: str = "backward", strict: bool = False) -> DataFrame:
    """Each left row with `values` of the nearest right row of its key, or nulls.

    One union and one window per key: the work grows with the rows, not with their pairs. `backward`
    takes the latest right row up to the left time, `forward` the earliest from it on; `strict` leaves
    out equal times. Right rows that tie in time are resolved by their values, the greatest one winning.
    """
    back = direction == "backward"
    lefts = left.columns
    packed = F.struct(*[F.col(v) for v in values], F.col(right_time).alias("__matched"))
    a = left.select(F.struct(*lefts).alias("__l"), F.lit(None).alias("__r"), F.col(key).alias("__k"), F.col(left_time).cast("timestamp_ntz").alias("__t"), F.lit(0 if strict else 1).alias("__s"))
    b = right.select(F.lit(None).alias("__l"), packed.alias("__r"), F.col(key).alias("__k"), F.col(right_time).cast("timestamp_ntz").alias("__t"), F.lit(1 if strict else 0).alias("__s"))
    time = F.col("__t").asc() if back else F.col("__t").desc()
    w = Window.partitionBy("__k").orderBy(time, "__s", "__r").rowsBetween(Window.unboundedPreceding, 0)
    both = a.union(b).withColumn("__m", F.last("__r", ignorenulls=True).over(w)).where("__l is not null")
    return both.select("__l.*", *[F.col(f"__m.{v}").alias(v) for v in values], F.col("__m.__matched").alias(f"matched_{right_time}"))


#: Days of a bin of the interval index.
BIN_DAYS = 32


def day_bin(at: Column, days: int = BIN_DAYS) -> Column:
    return F.floor(F.unix_date(at.cast("date")) / days)


def binned(intervals: DataFrame, start: str, end: str, first: Column, last: Column, rows: DataFrame, at: str) -> DataFrame:
    """`intervals` once for each bin of days that they touch within the rows' span of time, as __bin.

    `first` and `last` are the days to be covered, made from `start` and `end`. The rows' span is one row and broadcast; it
    keeps intervals that are open on a side from touching bins without rows.
    """
    span = rows.agg(F.min(F.col(at).cast("date")).alias("__low"), F.max(F.col(at).cast("date")).alias("__high"))
    low, high = F.greatest(first.cast("date"), F.col("__low")), F.least(last.cast("date"), F.col("__high"))
    cut = intervals.where(F.col(start).isNotNull() & F.col(end).isNotNull()).crossJoin(F.broadcast(span)).withColumns({"__low": low, "__high": high}).where("__low <= __high")
    return cut.withColumn("__bin", F.explode(F.sequence(day_bin(F.col("__low")), day_bin(F.col("__high"))))).drop("__low", "__high")


def valid_at(rows: DataFrame, intervals: DataFrame, on: str, at: str, start: str = "valid_from", end: str = "valid_to", how: str = "inner") -> DataFrame:
    """Join on a key where `at` lies in the interval, both ends included.

    Rows meet the intervals of their key and bin of days only, so a key with very many intervals doesn't
    compare each of its rows with all of them.
    """
    i = binned(intervals, start, end, F.col(start), F.col(end), rows, at).alias("i")
    r, point = rows.alias("r"), F.col(f"r.{at}")
    hit = (F.col(f"r.{on}") == F.col(f"i.{on}")) & (day_bin(point) == F.col("i.__bin")) & point.between(F.col(f"i.{start}"), F.col(f"i.{end}"))
    return r.join(i, hit, how)


def overlapping(rows: DataFrame, intervals: DataFrame, on: str, at: str, days: int, start: str = "from_date", end: str = "to_date") -> DataFrame:
    """Distinct (on, at) of rows whose [at, at + days] meets an interval: those that lie in the interval begun `days` earlier."""
    i = intervals.select(F.col(on).alias("__k"), F.date_sub(start, days).alias("__a"), F.col(end).alias("__b"))
    points = rows.select(on, at).distinct()
    i = binned(i, "__a", "__b", F.col("__a"), F.col("__b"), points, at)
    hit = (F.col(on) == F.col("__k")) & (day_bin(F.col(at)) == F.col("__bin")) & F.col(at).between(F.col("__a"), F.col("__b"))
    return points.join(i, hit, "left_semi")


def without_between(rows: DataFrame, events: DataFrame, on: str, after: str, upto: str, event: str) -> DataFrame:
    """Rows with no event of their key in (after, upto]: the first event behind `after` decides."""
    e = events.select(F.col(on), F.col(event).alias("__event"))
    found = asof_join(rows, e, on, after, "__event", ["__event"], "forward", strict=True)
    none = F.col("__event").isNull() | F.coalesce(F.col("__event") > F.col(upto), F.lit(True)) | F.col(on).isNull() | F.col(after).isNull()
    return found.where(none).select(*rows.columns)


def with_segment(rows: DataFrame, breaks: DataFrame, key: str = "company_id", time: str = "trade_date", event: str = "break_date") -> DataFrame:
    """Adds `segment`: how many breaks of the row's key lie on or before it (union and running sum)."""
    names = rows.columns
    a = rows.select(F.struct(*names).alias("__l"), F.col(key).alias("__k"), F.col(time).alias("__t"), F.lit(0).alias("__b"))
    b = breaks.select(F.lit(None).alias("__l"), F.col(key).alias("__k"), F.col(event).alias("__t"), F.lit(1).alias("__b"))
    w = Window.partitionBy("__k").orderBy("__t", F.col("__b").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return a.union(b).withColumn("segment", F.sum("__b").over(w)).where("__l is not null").select("__l.*", "segment")


def session_ordinals(days: DataFrame, day: str = "trade_date") -> DataFrame:
    """Distinct sessions numbered from 1; one row a session, so one window suffices."""
    return days.select(day).distinct().withColumn("n", F.row_number().over(Window.orderBy(day)))


def ordinal_band(months: DataFrame, ordinals: DataFrame, width: int) -> DataFrame:
    """(month, trade_date) for the `width` sessions before each month's first one; equi-joined by ordinal."""
    band = months.where("n0 > 1").select("month", F.explode(F.sequence(F.greatest(F.col("n0") - width, F.lit(1)), F.col("n0") - 1)).alias("n")).where("n > 0")
    return band.join(ordinals, "n").select("month", "trade_date")


def fallback_map(rows: DataFrame, exact: DataFrame, exact_key: str, intervals: DataFrame, on: str, at: str) -> DataFrame:
    """Map by an exact key first; rows without a match go by symbol and date."""
    first = rows.join(exact, exact_key)
    rest = rows.join(exact, exact_key, "left_anti")
    second = valid_at(rest, intervals, on, at).select("r.*", "i.company_id")
    return first.unionByName(second)


def coalesce_maps(rows: DataFrame, at_date: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """The mapping at the date, else the current one; unmatched rows stay with null."""
    a = at_date.select(F.col(key), F.col("company_id").alias("__at"))
    c = current.select(F.col(key).alias("__k"), F.col("company_id").alias("__now"))
    out = rows.join(a, key, "left")
    return out.join(c, F.col(key) == F.col("__k"), "left").withColumn("company_id", F.coalesce("__at", "__now")).drop("__at", "__now", "__k")


def in_band(value: Column, low: Column, high: Column) -> Column:
    return (value >= low) & (value <= high)
