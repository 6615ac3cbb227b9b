"""Which company a symbol stood for, day by day, from the spans in which it traded and the renames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import groups

# The first and the last day of a segment that is open on that side.
OPEN_START = "1900-01-01"
OPEN_END = "9999-12-31"


def relevant_changes(observed: DataFrame, changes: DataFrame) -> DataFrame:
    """Renames that touch a symbol which traded; those from a symbol to itself, or with a null, are left out."""
    seen = observed.select("symbol", F.lit(True).alias("hit")).distinct()
    once = changes.select("old_symbol", "new_symbol", "change_date").where("old_symbol <> new_symbol and change_date is not null").distinct()
    old = seen.select(F.col("symbol").alias("old_symbol"), F.col("hit").alias("old_hit"))
    new = seen.select(F.col("symbol").alias("new_symbol"), F.col("hit").alias("new_hit"))
    return once.join(old, "old_symbol", "left").join(new, "new_symbol", "left").where("old_hit or new_hit").drop("old_hit", "new_hit")


def symbol_segments(observed: DataFrame, changes: DataFrame) -> DataFrame:
    """(symbol, valid_from, valid_to): each symbol cut at the days on which it was taken up or given away.

    A symbol has at most one segment more than there are days, so the window over a symbol's cuts stays small.
    """
    cuts = changes.select(F.col("old_symbol").alias("symbol"), "change_date").union(changes.select("new_symbol", "change_date"))
    symbols = observed.select("symbol").union(cuts.select("symbol"))
    starts = cuts.union(symbols.withColumn("d", F.lit(OPEN_START).cast("date"))).select("symbol", F.col("change_date").alias("valid_from")).distinct()
    following = F.lead("valid_from").over(Window.partitionBy("symbol").orderBy("valid_from"))
    return starts.withColumn("valid_to", F.coalesce(F.date_sub(following, 1), F.lit(OPEN_END).cast("date")))


def symbol_map(observed: DataFrame, changes: DataFrame) -> DataFrame:
    """(company_id, symbol, valid_from, valid_to, first_traded, last_traded): a row for each segment that traded.

    `observed` has symbol, first_seen, last_seen (one row a symbol), `changes` old_symbol, new_symbol, change_date. A rename
    on day d links the old symbol's segment that ends on d - 1 with the new symbol's that starts on d; both days are cuts,
    so the links are equality joins. Linked segments are one company, named by the symbol of the segment that traded
    last (then began last, then has the largest name). A symbol that another company takes up later is cut there, and
    its segments fall to different companies unless links connect them, as they do where a company takes its old name back.
    """
    changes = relevant_changes(observed, changes)
    segments = symbol_segments(observed, changes)
    given = segments.select(F.col("symbol").alias("old_symbol"), "valid_from", F.date_add("valid_to", 1).alias("change_date"))
    node = lambda symbol, start: F.struct(F.col(symbol).alias("symbol"), F.col(start).alias("valid_from"))
    links = changes.join(given, ["old_symbol", "change_date"]).select(node("old_symbol", "valid_from").alias("u"), node("new_symbol", "change_date").alias("v"))
    heads = groups(links)
    low, high = F.greatest("first_seen", "valid_from"), F.least("last_seen", "valid_to")
    traded = segments.join(observed, "symbol").select("symbol", "valid_from", "valid_to", low.alias("first_traded"), high.alias("last_traded")).where("first_traded <= last_traded")
    traded = traded.withColumn("node", node("symbol", "valid_from")).join(heads, "node", "left").withColumn("head", F.coalesce("head", "node")).drop("node")
    names = traded.groupBy("head").agg(F.max_by("symbol", F.struct("last_traded", "valid_from", "symbol")).alias("company_id"))
    return traded.join(names, "head").select("company_id", "symbol", "valid_from", "valid_to", "first_traded", "last_traded")
