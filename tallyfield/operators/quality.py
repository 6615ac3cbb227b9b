"""Validation, flags, scores, calendar and coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import with_segment
from .tables import looks_like_split, ohlc_broken

ISSUE = ("rule", "severity", "n")


def issues(df: DataFrame, rules: dict[str, tuple[str, Column]], by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, rule, severity, n) of each rule that some row of a group breaks; all rules in one pass over `df`."""
    names = list(rules)
    counted = df.groupBy(*by).agg(*[F.count(F.when(cond, 1)).alias(n) for n, (_, cond) in rules.items()])
    packed = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(rules[n][0]).alias("severity"), F.col(n).alias("n")) for n in names])
    return counted.select(*by, F.explode(packed).alias("x")).select(*by, "x.*").where("n > 0")


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def repeated_keys(df: DataFrame, keys: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    twice = df.groupBy(*by, *keys).count().where("count > 1").groupBy(*by).agg(F.count("*").alias("n")).where("n > 0")
    return twice.select(*by, F.lit("duplicate_keys").alias("rule"), F.lit("BLOCK").alias("severity"), "n")


def validate_prices(df: DataFrame, min_rows: int, required: list[str], keys: list[str], expected: dict[str, tuple] | None = None, by: str = "file_date") -> DataFrame:
    """Issues of each day's price file: too few rows, other dates, missing values, repeated keys, unexpected segments or exchanges."""
    rules = {"date_mismatch": ("BLOCK", F.col("trade_date") != F.col(by)), "required_nulls": ("BLOCK", _any([F.col(c).isNull() for c in required]))}
    for column, values in (expected or {}).items():
        rules[f"unexpected_{column}"] = ("WARN", ~F.coalesce(F.col(column).isin(*values), F.lit(False)))
    few = df.groupBy(by).agg(F.count("*").alias("n")).where(F.col("n") < min_rows).select(by, F.lit("too_few_rows").alias("rule"), F.lit("BLOCK").alias("severity"), "n")
    return issues(df, rules, (by,)).unionByName(few).unionByName(repeated_keys(df, keys, (by,)))


def validate_delivery(df: DataFrame, required: list[str], keys: list[str], by: str = "trade_date") -> DataFrame:
    """Issues of each day's delivery file: missing values, negative quantities, more delivered than traded, repeated keys."""
    rules = {
        "required_nulls": ("BLOCK", _any([F.col(c).isNull() for c in required])), "negative": ("BLOCK", (F.col("qty_traded") < 0) | (F.col("deliverable_qty") < 0)),
        "deliverable_over_traded": ("WARN", F.col("deliverable_qty") > F.col("qty_traded")),
    }
    return issues(df, rules, (by,)).unionByName(repeated_keys(df, keys, (by,)))


def validate_index(df: DataFrame, core: list[str]) -> DataFrame:
    """Core indices missing or repeated block; others and null closes warn."""
    per = df.groupBy(F.lower("index_name").alias("name")).agg(F.count("*").alias("n"), F.count(F.when(F.col("close").isNull(), 1)).alias("nulls"))
    is_core = F.col("name").isin(*core)
    found = issues(per, {"core_repeated": ("BLOCK", is_core & (F.col("n") > 1)), "repeated": ("WARN", ~is_core & (F.col("n") > 1)), "null_close": ("WARN", F.col("nulls") > 0)})
    missing = per.agg(F.count(F.when(is_core, 1)).alias("have")).select(F.lit("core_missing").alias("rule"), F.lit("BLOCK").alias("severity"), (len(core) - F.col("have")).alias("n")).where("n > 0")
    return found.unionByName(missing)


def validate_actions(df: DataFrame, by: str = "month") -> DataFrame:
    """Issues of each month's action file: rows without a key, ex-dates outside the month."""
    return issues(df, {"null_key": ("BLOCK", F.col("company_id").isNull() | F.col("ex_date").isNull()), "outside_month": ("WARN", F.date_format("ex_date", "yyyy-MM") != F.col(by))}, (by,))


def validate_reference(df: DataFrame, keys: list[str], today: Column, date: str = "change_date") -> DataFrame:
    """Issues of a reference file: rows without a key, change dates in the future."""
    return issues(df, {"null_key": ("BLOCK", _any([F.col(c).isNull() for c in keys])), "future_date": ("WARN", F.col(date) > today)})


def validate_results(df: DataFrame, keys: list[str], time: str = "published_at", share: float = 0.05, by: tuple[str, ...] = ()) -> DataFrame:
    """Issues of filings: rows without a key, and more than `share` of them without a publication time."""
    found = issues(df, {"null_key": ("BLOCK", _any([F.col(c).isNull() for c in keys]))}, by)
    late = df.groupBy(*by).agg(F.count(F.when(F.col(time).isNull(), 1)).alias("n"), F.count("*").alias("all")).where(F.col("n") > share * F.col("all"))
    return found.unionByName(late.select(*by, F.lit("missing_times").alias("rule"), F.lit("WARN").alias("severity"), "n"))


def price_flags(bars: DataFrame, adjusted: DataFrame, breaks: DataFrame, factors: DataFrame, continuity: DataFrame, events: DataFrame, gap_days: int = 15) -> DataFrame:
    """(company_id, from_date, to_date, check, severity, detail): the ranges of dates that each check casts doubt on.

    Bars that break the price order; big adjusted moves without a break or an event between, split-like ones as a
    possible missing action; trading gaps; adjustments that failed the continuity check; price actions and
    dividends whose wording is not understood. Ranges that end before they start are left out. The four checks of
    bars are columns of one pass, in windows over one partitioning by company.
    """
    c, own = F.col, Window.partitionBy("company_id")
    w = own.orderBy("trade_date")
    # a running count of breaks and price actions: a change between two bars tells one that lies between them
    halts = breaks.select("company_id", c("break_date").alias("day")).unionByName(factors.where("abs(price_factor - 1) > 1e-9").select("company_id", c("ex_date").alias("day")))
    rows = bars.select("company_id", "trade_date", "open", "high", "low", "close", "volume").join(adjusted.select("company_id", "trade_date", "adj_close"), ["company_id", "trade_date"])
    rows = with_segment(rows, halts, event="day")
    lag = lambda x: F.lag(x).over(w)
    rows = rows.withColumns({
        "bad": ohlc_broken(), "first_day": F.min("trade_date").over(own), "prev_date": lag("trade_date"), "prior": lag("close"), "prev_adj": lag("adj_close"),
        "gap": F.datediff("trade_date", lag("trade_date")), "joined": F.coalesce(c("segment") == lag("segment"), F.lit(False)),
    })
    rows = rows.withColumns({"raw": F.try_divide("close", "prior"), "move": F.try_divide("adj_close", "prev_adj") - 1})
    big = c("joined") & (F.abs("move") > 0.2 + F.try_divide(F.lit(0.1), c("prev_adj")))
    split_like = looks_like_split(c("raw"), c("prior"), c("gap"))
    before = lambda d: F.date_sub(d, 1)
    flag = lambda a, b, check, severity, *detail: F.struct(a.alias("from_date"), b.alias("to_date"), F.lit(check).alias("check"), F.lit(severity).alias("severity"), F.to_json(F.struct(*detail)).alias("detail"))
    day, first = c("trade_date"), c("first_day")
    found = F.array(
        F.when(c("bad"), flag(day, day, "ohlc_integrity", "BLOCK", "open", "close")),
        F.when(big & split_like, flag(first, before(day), "possible_missing_action", "BLOCK", F.round("raw", 6).alias("raw"))),
        F.when(big & ~split_like, flag(day, day, "large_move", "WARN", F.round("move", 6).alias("move"))),
        F.when(c("joined") & (c("gap") > gap_days), flag(F.date_add("prev_date", 1), before(day), "trading_gap", "WARN", "gap")),
    )
    spread = lambda df: df.select("company_id", F.explode(F.array_compact("found")).alias("f")).select("company_id", "f.*")
    starts = bars.groupBy("company_id").agg(F.min("trade_date").alias("first_day"))
    failed = continuity.where("not passed").join(starts, "company_id")
    failed = failed.withColumn("found", F.array(flag(first, before(c("ex_date")), "unreconciled_adjustment", "BLOCK", F.round("adj_move", 6).alias("adj_move"))))
    unread = events.where("status = 'unparsed'").join(starts, "company_id", "left")
    wording = F.when(c("kind") == "dividend", flag(c("ex_date"), c("ex_date"), "unparsed_dividend", "WARN", "subject")).otherwise(flag(F.coalesce("first_day", "ex_date"), before(c("ex_date")), "unparsed_action", "BLOCK", "subject"))
    unread = unread.where("kind is not null").withColumn("found", F.array(wording))
    return spread(rows.withColumn("found", found)).unionByName(spread(failed)).unionByName(spread(unread)).where("from_date <= to_date")


#: Fixed weights of the daily score's parts, and the share at and below which a part counts nothing.
WEIGHTS = {"prices": 35, "gates": 25, "actions": 15, "delivery": 15, "index": 10}
FLOORS = {"prices": 0.95, "gates": 0.90, "delivery": 0.90}
CORE_INDICES = 3


def daily_members(members: DataFrame, prices: DataFrame, flags: DataFrame) -> DataFrame:
    """(trade_date, members, priced, blocked, delivered) of a universe's members (month, company_id) over the sessions of `prices`."""
    sessions = prices.select("trade_date").distinct().withColumn("month", F.date_format("trade_date", "yyyy-MM"))
    m = sessions.join(members.select("month", "company_id"), "month").select("trade_date", "company_id")
    f = flags.where("severity = 'BLOCK'").select(F.col("company_id").alias("k"), "from_date", "to_date")
    blocked = m.join(f, (F.col("company_id") == F.col("k")) & F.col("trade_date").between(F.col("from_date"), F.col("to_date")), "left_semi").withColumn("blocked", F.lit(1))
    p = prices.select("trade_date", "company_id", F.lit(1).alias("priced"), F.col("delivery_pct").isNotNull().cast("int").alias("delivered"))
    day = m.join(p, ["trade_date", "company_id"], "left").join(blocked, ["trade_date", "company_id"], "left")
    return day.groupBy("trade_date").agg(F.count("*").alias("members"), F.count("priced").alias("priced"), F.count("blocked").alias("blocked"), F.coalesce(F.sum("delivered"), F.lit(0)).alias("delivered"))


def quality_score(members: DataFrame, prices: DataFrame, flags: DataFrame, index_days: DataFrame, action_months: DataFrame) -> DataFrame:
    """Daily weighted score, 0 to 100.

    `index_days` has (trade_date, core): how many core indices have a close; `action_months` the months whose
    actions are loaded. Shares count from their floor (nothing) to 1 (fully).
    """
    per = daily_members(members, prices, flags)
    per = per.join(index_days.select("trade_date", "core"), "trade_date", "left")
    per = per.withColumn("month", F.date_format("trade_date", "yyyy-MM")).join(action_months.select("month", F.lit(1.0).alias("loaded")).distinct(), "month", "left")
    scaled = lambda x, k: F.least(F.greatest((x - FLOORS[k]) / (1 - FLOORS[k]), F.lit(0.0)), F.lit(1.0))
    share = F.when(F.col("priced") == 0, 0.0).otherwise(F.try_divide("delivered", "priced"))
    parts = {
        "prices": scaled(F.col("priced") / F.col("members"), "prices"), "gates": scaled(1 - F.col("blocked") / F.col("members"), "gates"), "actions": F.coalesce("loaded", F.lit(0.0)),
        "delivery": scaled(share, "delivery"), "index": F.coalesce(F.col("core") / CORE_INDICES, F.lit(0.0)),
    }
    return per.select("trade_date", "members", "priced", "blocked", F.round(reduce(lambda a, b: a + b, [w * parts[k] for k, w in WEIGHTS.items()]), 2).alias("score"))


def completeness(members: DataFrame, prices: DataFrame, index_days: DataFrame) -> DataFrame:
    """Per session: members, shares of them priced and delivered in percent, and core indices present."""
    none = prices.limit(0).select("company_id", F.col("trade_date").alias("from_date"), F.col("trade_date").alias("to_date"), F.lit("BLOCK").alias("severity"))
    per = daily_members(members, prices, none).join(index_days.select("trade_date", "core"), "trade_date", "left")
    pct = lambda a, b: F.round(100 * F.try_divide(a, b), 2)
    return per.select("trade_date", "members", "priced", pct(F.col("priced"), F.col("members")).alias("priced_pct"), pct(F.col("delivered"), F.col("priced")).alias("delivered_pct"), F.coalesce("core", F.lit(0)).cast("long").alias("core"))


def cross_check(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float = 0.005) -> DataFrame:
    """One row: keys in both sources, in one only, and the share of common ones whose values agree."""
    j = a.select(*keys, F.col(value).alias("x"), F.lit(1).alias("ia")).join(b.select(*keys, F.col(value).alias("y"), F.lit(1).alias("ib")), keys, "full")
    both = F.col("ia").isNotNull() & F.col("ib").isNotNull()
    return j.agg(F.count(F.when(both, 1)).alias("common"), F.count(F.when(F.col("ib").isNull(), 1)).alias("only_a"), F.count(F.when(F.col("ia").isNull(), 1)).alias("only_b"), F.round(F.avg(F.when(both, (F.abs(F.col("x") - F.col("y")) <= tolerance).cast("double"))), 6).alias("agree"))


def calendar_years(status: DataFrame) -> DataFrame:
    """(year, sessions, holidays, weekends, expected) of a calendar (day, status)."""
    n = lambda v: F.count(F.when(F.col("status") == v, 1))
    return status.groupBy(F.year("day").cast("long").alias("year")).agg(n("session").alias("sessions"), n("holiday").alias("holidays"), n("weekend").alias("weekends"), n("expected").alias("expected"))


def quarantine_summary(quarantine: DataFrame) -> DataFrame:
    """(source_id, severity, open, resolved) of quarantined partitions."""
    return quarantine.groupBy("source_id", "severity").agg(F.count(F.when(F.col("resolved_at").isNull(), 1)).alias("open"), F.count("resolved_at").alias("resolved"))


def coverage_gate(complete: DataFrame, attempts: DataFrame, sources: list[str], floor: float = 98.0) -> DataFrame:
    """One row: the worst session's priced share, sources without any loaded partition, and whether the lake passes."""
    worst = complete.agg(F.min("priced_pct").alias("worst_pct"), F.count(F.when(F.col("priced_pct") < floor, 1)).alias("sessions_below"))
    have = attempts.where((F.col("status") == "success") & F.col("source_id").isin(*sources)).agg(F.countDistinct("source_id").alias("have"))
    # two one-row tables side by side
    return worst.crossJoin(have).select("worst_pct", "sessions_below", (len(sources) - F.col("have")).alias("sources_missing")).withColumn("passed", (F.col("sessions_below") == 0) & (F.col("sources_missing") == 0))


def quality_gate(scores: DataFrame, continuity: DataFrame, known: DataFrame) -> DataFrame:
    """One row: the share of continuous events, of known ones present and passed, of good days, and the verdict."""
    c = continuity.agg(F.avg(F.col("passed").cast("double")).alias("continuous"))
    k = known.join(continuity.select("company_id", "ex_date", "passed"), ["company_id", "ex_date"], "left").agg(F.coalesce(F.bool_and(F.coalesce("passed", F.lit(False))), F.lit(True)).alias("known_ok"))
    s = scores.agg(F.avg((F.col("score") >= 95).cast("double")).alias("good_days"), F.max_by("score", "trade_date").alias("latest"))
    # three one-row tables side by side
    out = c.crossJoin(k).crossJoin(s)
    return out.withColumn("passed", (F.col("continuous") >= 0.98) & F.col("known_ok") & (F.col("good_days") >= 0.95) & (F.col("latest") >= 95))


def latest_attempts(df: DataFrame, keys: tuple[str, ...] = ("source_id", "partition_key")) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("started_at"), F.desc("job_run_id"))
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def infer_holidays(attempts: DataFrame, sessions: DataFrame, listed: DataFrame) -> DataFrame:
    """Weekdays before the last session on which every source's latest attempt found no file."""
    last = latest_attempts(attempts).groupBy("partition_key").agg(F.bool_and(F.col("status") == "not_available").alias("none"))
    top = sessions.agg(F.max("day").alias("top"))
    out = last.where(F.col("none") & (F.weekday("partition_key") < 5)).join(top, F.col("partition_key") < F.col("top")).select(F.col("partition_key").alias("day"))
    return out.join(sessions.select("day"), "day", "left_anti").join(listed.select("day"), "day", "left_anti")


def calendar_status(spark, start: str, end: str, sessions: DataFrame, holidays: DataFrame) -> DataFrame:
    """(day, status): session before holiday before weekend before expected."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day"))
    out = days.join(sessions.select("day", F.lit(True).alias("s")).distinct(), "day", "left").join(holidays.select("day", F.lit(True).alias("h")).distinct(), "day", "left")
    return out.select("day", F.when(F.col("s"), "session").when(F.col("h"), "holiday").when(F.weekday("day") >= 5, "weekend").otherwise("expected").alias("status"))


def coverage(attempts: DataFrame) -> DataFrame:
    """Per source and year: partitions loaded, without a file, failed, and the loaded share."""
    last = latest_attempts(attempts)
    n = lambda v: F.count(F.when(F.col("status") == v, 1))
    out = last.groupBy("source_id", F.year("partition_key").cast("long").alias("year")).agg(n("success").alias("loaded"), n("not_available").alias("no_file"), n("failed").alias("failed"), F.count("*").alias("partitions"))
    return out.withColumn("loaded_pct", F.round(100 * F.col("loaded") / F.col("partitions"), 2))
