"""Corporate actions, adjustment, universe and identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lake import stored
from .intervals import asof_join, ordinal_band, session_ordinals, valid_at, without_between
from .subjects import parse_actions
from .tables import keep_last

def rights_factor(prior: Column, ratio_new: Column, ratio_held: Column, issue: Column) -> Column:
    """Theoretical ex-rights price over the prior close, at most 1."""
    return F.least(F.lit(1.0), F.try_divide((ratio_held * prior + ratio_new * issue) / (ratio_held + ratio_new), prior))


def build_events(actions: DataFrame, mapping: DataFrame, key: str = "company_id") -> DataFrame:
    """Distinct (company, ex_date, subject) with parsed components; the mapping may leave a company null."""
    once = keep_last(actions, [key, "ex_date", "subject"], *[F.asc(c) for c in actions.columns])
    parsed = stored(parse_actions(once.select("subject").distinct()))  # a wording is read once, however often it occurs and is asked for
    columns = [*once.columns, *parsed.columns[1:]]
    return once.join(parsed, "subject").select(*columns).join(mapping, key, "left")


def build_factors(events: DataFrame, closes: DataFrame, face_value: float = 10.0) -> DataFrame:
    """(company_id, ex_date, price_factor, dividend_factor, kinds): the product of an ex-date's factors.

    Rights and dividends need the last close before the ex-date; events that cannot be priced are left out.
    """
    priced = asof_join(events, closes, "company_id", "ex_date", "trade_date", ["close"], "backward", strict=True)
    c = F.col
    price = F.when(c("kind") == "rights", rights_factor(c("close"), c("ratio_new"), c("ratio_held"), face_value + c("rights_premium"))).otherwise(c("price_factor"))
    cash = F.when((c("kind") == "dividend") & (c("dividend_per_share") < c("close")), 1 - c("dividend_per_share") / c("close"))
    out = priced.where("status = 'parsed'").withColumns({"pf": price, "df": cash}).where("pf is not null or df is not null")
    return out.groupBy("company_id", "ex_date").agg(F.product(F.coalesce("pf", F.lit(1.0))).alias("price_factor"), F.product(F.coalesce("df", F.lit(1.0))).alias("dividend_factor"), F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"))


def cumulative_factors(factors: DataFrame) -> DataFrame:
    w = Window.partitionBy("company_id").orderBy(F.col("ex_date").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return factors.select("company_id", "ex_date", F.product("price_factor").over(w).alias("f"), F.product("dividend_factor").over(w).alias("df"))


def adjusted_prices(bars: DataFrame, factors: DataFrame) -> DataFrame:
    """Prices times, and volume over, the product of all factors with a later ex-date; tr_close adds dividends."""
    j = asof_join(bars, cumulative_factors(factors), "company_id", "trade_date", "ex_date", ["f", "df"], "forward", strict=True)
    f = F.coalesce("f", F.lit(1.0))
    return j.select("company_id", "trade_date", *[(F.col(c) * f).alias(f"adj_{c}") for c in ("open", "high", "low", "close")], (F.col("volume") / f).alias("adj_volume"), (F.col("close") * f * F.coalesce("df", F.lit(1.0))).alias("tr_close"), f.alias("factor"))


def continuity_check(bars: DataFrame, factors: DataFrame, breaks: DataFrame, max_gap_days: int = 15) -> DataFrame:
    """Raw and adjusted move over every ex-date, and whether the adjusted one is small enough."""
    b = bars.select("company_id", "trade_date", "close")
    before = asof_join(factors, b, "company_id", "ex_date", "trade_date", ["close"], "backward", strict=True).withColumnsRenamed({"close": "c0", "matched_trade_date": "d0"})
    both = asof_join(before, b, "company_id", "ex_date", "trade_date", ["close"], "forward").withColumnsRenamed({"close": "c1", "matched_trade_date": "d1"})
    both = both.where((F.datediff("d1", "d0") <= max_gap_days)).join(breaks.select("company_id", F.col("break_date").alias("ex_date")), ["company_id", "ex_date"], "left_anti")
    raw = F.col("c1") / F.col("c0") - 1
    adj = F.col("c1") / (F.col("c0") * F.col("price_factor")) - 1
    return both.select("company_id", "ex_date", raw.alias("raw_move"), adj.alias("adj_move"), (F.abs(adj) <= 0.20 + 0.10 / (F.col("c0") * F.col("price_factor"))).alias("passed"))


def build_universe(prices: DataFrame, size: int = 500, window: int = 126, share: float = 0.9) -> DataFrame:
    """Per month the `size` companies of largest median traded value over the `window` sessions before it."""
    ordinals = session_ordinals(prices)
    months = ordinals.groupBy(F.date_format("trade_date", "yyyy-MM").alias("month")).agg(F.min("n").alias("n0")).where(F.col("n0") > window)
    rows = prices.join(ordinal_band(months, ordinals, window), "trade_date")
    per = rows.groupBy("month", "company_id").agg(F.median("value_inr").alias("median_value_inr"), F.count("*").alias("sessions_traded"), F.max("trade_date").alias("as_of")).where(F.col("sessions_traded") >= int(window * share))
    return per.withColumn("rank", F.row_number().over(Window.partitionBy("month").orderBy(F.desc("median_value_inr"), "company_id")).cast("long")).where(F.col("rank") <= size)


def company_prices(rows: DataFrame, symbol_map: DataFrame, boards: tuple[str, ...], prefer: Column) -> DataFrame:
    """Rows of the given boards mapped to companies by date, one per company and day by preference, which `rows` decide on.

    A symbol's rows of a day all meet the same companies, so the best of them is found first; only that one is mapped.
    """
    given = rows.where(F.col("series").isin(*boards)).withColumn("__prefer", prefer)
    rest = [c for c in given.columns if c not in ("symbol", "trade_date")]
    first = F.struct("__prefer", "row_id")
    best = given.groupBy("symbol", "trade_date").agg(F.min_by(F.struct(*rest), first).alias("x")).select("symbol", "trade_date", "x.*")
    j = valid_at(stored(best), symbol_map, "symbol", "trade_date").select("r.*", "i.company_id")
    return keep_last(j, ["company_id", "trade_date"], F.asc("__prefer"), F.asc("symbol"), F.asc("row_id")).select(*rows.columns, "company_id")


def company_delivery(prices: DataFrame, delivery: DataFrame, rule_series: tuple[str, ...] = ("BE", "BZ")) -> DataFrame:
    """(company_id, trade_date, delivery_pct, delivery_source): as reported, or 100 by the rule of trade-for-trade series."""
    j = prices.select("company_id", "trade_date", "series").join(delivery.select("company_id", "trade_date", F.col("delivery_pct").alias("reported")), ["company_id", "trade_date"], "left")
    rule = F.col("series").isin(*rule_series)
    return j.select("company_id", "trade_date", F.when(rule, 100.0).otherwise(F.col("reported")).alias("delivery_pct"), F.when(rule, "rule").when(F.col("reported").isNotNull(), "reported").alias("delivery_source"))


def results_targets(filings: DataFrame, trading: DataFrame, days: int = 120) -> DataFrame:
    """One filing for each company and quarter: consolidated before standalone, then the first published.

    Filings name a symbol, which may have meant several companies (symbol, company_id, first_day, last_day): the one that
    traded under it at publication counts, or up to `days` later; of several the one that began last.
    """
    held = trading.select(F.col("symbol").alias("__s"), "company_id", "first_day", "last_day")
    day = F.col("published_at").cast("date")
    j = filings.join(held, (F.col("symbol") == F.col("__s")) & (F.col("first_day") <= F.date_add(day, days)) & (F.col("last_day") >= day)).drop("__s", "last_day")
    j = keep_last(j, ["filing_id"], F.desc("first_day"), F.asc("company_id")).drop("first_day")
    return keep_last(j, ["company_id", "period_to"], F.desc("consolidated"), F.asc("published_at"), F.asc("filing_id"))


def load_fundamentals(facts: DataFrame) -> DataFrame:
    """Of every company and quarter the facts fetched last."""
    return keep_last(facts, ["company_id", "period_to"], F.desc("fetched_at"), F.desc("filing_id"))


def stretches_without_events(bars: DataFrame, events: DataFrame) -> DataFrame:
    """Consecutive bars with no event between them: the pairs a gap check may compare."""
    w = Window.partitionBy("company_id").orderBy("trade_date")
    pairs = bars.select("company_id", "trade_date", F.lag("trade_date").over(w).alias("prev_date")).where("prev_date is not null")
    return without_between(pairs, events, "company_id", "prev_date", "trade_date", "ex_date")
