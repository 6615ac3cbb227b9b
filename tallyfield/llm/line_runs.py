"""Line deduplication by a suffix array over line-ID sequences.

Every document is a sequence of line IDs (128-bit hashes of lines without outer blanks; blank lines don't
count). Prefix doubling ranks the suffixes: level k holds the suffixes whose first 2**k lines occur
elsewhere too, with the rank of that prefix among all of them, refined from level k - 1 by the rank that
stands 2**(k-1) lines further on. Ranks of equal prefixes are the intervals of longest common prefixes.
A descent over the levels then finds, for every suffix, the deepest such interval that also holds an
earlier suffix: the longest run of lines that has occurred before. Later copies of runs of enough
characters are deleted; the first one stays.

All steps are joins, windows and aggregates that combine before they shuffle. What a very common line or
passage is joined with is always a table of its own, so that Spark can split the rows of such a key;
ranks are sums within bounded ranges plus the sums of the ranges before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

#: A repeated run is deleted if its lines have so many characters in all.
MIN_CHARS = 40
BLANKS = "\x20\t\n\x0b\f\r"
_AT = ["d", "t", "pos"]
_ID = ["run", "name", "piece"]


def _key(df: DataFrame, id_col: str) -> Column:
    """What orders documents: the id as a number, other types as text; a null id comes first."""
    if df.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        return F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    return F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit(""))


def line_table(df: DataFrame) -> DataFrame:
    """(d, t, pos, line, chars, h1, h2): the lines of (d, text) that aren't blank; pos counts them, line counts all."""
    text = F.coalesce("text", F.lit(""))
    lines = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("line"), F.btrim(x, F.lit(BLANKS)).alias("s")))
    full = F.filter(lines, lambda x: F.length(x["s"]) > 0)
    rows = df.select("d", F.xxhash64(text).alias("t"), F.posexplode(full).alias("pos", "x"))
    return rows.select("d", "t", "pos", "x.line", F.length("x.s").alias("chars"), F.xxhash64("x.s").alias("h1"), F.xxhash64(F.lit(1), "x.s").alias("h2"))


def _sums_before(rows: DataFrame, part: list[str], bucket: Column, order: list[str]) -> DataFrame:
    """`rows` with `before`: the sum of `count` over the rows of the same `part` that come earlier in `order`.

    Buckets follow the order. A sum within the bucket is added to that of the earlier buckets, so
    no task ever holds more than a bucket, or one row for each bucket.
    """
    earlier = lambda w: F.coalesce(F.sum("count").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("bucket", bucket)
    bases = rows.groupBy(*part, "bucket").agg(F.sum("count").alias("count"))
    bases = bases.select(*part, "bucket", earlier(Window.partitionBy(*part).orderBy("bucket")).alias("base"))
    inside = rows.withColumn("inside", earlier(Window.partitionBy(*part, "bucket").orderBy(*order)))
    return inside.join(bases, [*part, "bucket"]).withColumn("before", F.col("base") + F.col("inside")).drop("base", "inside", "bucket")


def _first_ranks(lines: DataFrame) -> DataFrame:
    """(d, t, pos, chars, line, rank) of lines that occur twice at least; rank: how many such lines have a smaller ID."""
    per = materialize(lines.groupBy("h1", "h2").count().where("count > 1"), "line-ids")
    ranks = _sums_before(per, [], F.shiftright("h1", 50), ["h1", "h2"]).select("h1", "h2", F.col("before").alias("rank"))
    # rows that repeat an id and a text are one document
    out = materialize(lines.join(ranks, ["h1", "h2"]).select(*_AT, "line", "chars", "rank").dropDuplicates(_AT), "level-0")
    discard(per)
    return out


def _doubled(level: DataFrame, k: int) -> DataFrame:
    """Level k + 1 from level k: suffixes whose first 2**(k+1) lines occur twice at least."""
    ahead = Window.partitionBy("d", "t").orderBy("pos").rangeBetween(2**k, 2**k)
    pairs = level.select(*_AT, "rank", F.max("rank").over(ahead).alias("next")).where("next is not null")
    # a pair's rank: the rank so far and how many suffixes of that rank go on with a smaller one that occurs again
    named = _sums_before(pairs.groupBy("rank", "next").count().where("count > 1"), ["rank"], F.shiftright("next", 18), ["next"])
    return pairs.join(named, ["rank", "next"]).select(*_AT, (F.col("rank") + F.col("before")).alias("rank"))


def suffix_levels(lines: DataFrame, most: int = 40) -> list[DataFrame]:
    levels = [_first_ranks(lines)]
    while len(levels) < most and not levels[-1].isEmpty():
        levels.append(materialize(_doubled(levels[-1], len(levels) - 1), f"level-{len(levels)}"))
    if levels[-1].isEmpty():
        discard(levels.pop())
    return levels


def longest_previous_runs(levels: list[DataFrame]) -> DataFrame:
    """(d, t, pos, run): how many lines from a position on also occur, in one piece, from an earlier position on."""
    here = F.struct(*_AT)
    # run: lines matched so far; name: that prefix; first: the first suffix that has it
    now = levels[0].select(*_AT, F.lit(0).alias("run"), F.lit(0).cast("long").alias("name"), F.when(F.lit(False), here).alias("first"))
    spent: list[DataFrame] = []
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k].select(F.col("d").alias("d2"), F.col("t").alias("t2"), F.col("pos").alias("p2"), F.col("rank").alias("piece"))
        ahead = lambda d, t, p: (F.col(d) == F.col("d2")) & (F.col(t) == F.col("t2")) & (F.col(p) + F.col("run") == F.col("p2"))
        own = materialize(now.join(level, ahead("d", "t", "pos"), "left").select(*_AT, "run", "name", "first", "piece"), "runs")
        firsts = own.where("first is not null").groupBy("run", "name").agg(F.min("first").alias("first")).join(level, ahead("first.d", "first.t", "first.pos"))
        keyed = own.where("piece is not null").select(*_ID, here.alias("at")).union(firsts.select(*_ID, "first"))
        least = materialize(keyed.groupBy(*_ID).agg(F.min("at").alias("lead"), F.count("*").alias("n")).where("n > 1").select(*_ID, "lead"), "leads")
        for x in spent:
            discard(x)
        spent = [own, least]
        longer = F.col("lead") < here
        found = own.where("piece is not null").join(least, _ID, "left")
        now = found.unionByName(own.where("piece is null").withColumn("lead", F.when(F.lit(False), here))).select(
            *_AT, F.when(longer, F.col("run") + 2**k).otherwise(F.col("run")).alias("run"),
            F.when(longer, F.xxhash64(*_ID)).otherwise(F.col("name")).alias("name"), F.when(longer, F.col("lead")).otherwise(F.col("first")).alias("first"),
        )
    out = materialize(now.where("run > 0").select(*_AT, "run"), "runs")
    for x in spent:
        discard(x)
    return out


def _marker(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(2)
            doc = np.repeat(np.arange(len(x)), np.diff(np.asarray(x.offsets)))
            pos, size, chars, line = (np.asarray(c).astype(np.int64) for c in x.flatten().flatten())
            o = np.lexsort((pos, doc))
            doc, pos, size, chars, line = doc[o], pos[o], size[o], chars[o], line[o]
            upto = np.concatenate(([0], np.cumsum(chars)))
            # a document's repeated lines: the run from i on ends before the first of them at pos + size or later
            key = doc * (1 << 40) + pos
            stop = np.searchsorted(key, key + size)
            good = (size > 0) & (upto[stop] - upto[:-1] >= min_chars)
            change = np.zeros(len(pos) + 1, dtype=np.int64)
            np.add.at(change, np.flatnonzero(good), 1)
            np.add.at(change, stop[good], -1)
            lost = np.cumsum(change[:-1]) > 0
            ends = np.concatenate(([0], np.cumsum(np.bincount(doc[lost], minlength=len(x))))).astype(np.int32)
            gone = pa.ListArray.from_arrays(pa.array(ends), pa.array(line[lost].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), gone], names=["d", "t", "gone"])

    return run


def repeated_lines(rows: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(d, t, gone): for documents of (d, text) that lose lines, the numbers of those lines, ascending."""
    kind = rows.schema["d"].dataType.simpleString()
    lines = materialize(line_table(rows), "lines")
    levels = suffix_levels(lines)
    discard(lines)
    schema = f"d {kind}, t long, gone array<int>"
    if not levels:
        return rows.sparkSession.createDataFrame([], schema)
    runs = longest_previous_runs(levels)
    # every line of a run starts a run itself, so the starts are all lines that can go
    per = runs.join(levels[0].select(*_AT, "line", "chars"), _AT)
    per = per.groupBy("d", "t").agg(F.collect_list(F.struct("pos", "run", "chars", "line")).alias("rows"))
    marked = materialize(per.mapInArrow(_marker(min_chars), schema).where(F.size("gone") > 0), "gone")
    for x in (*levels, runs):
        discard(x)
    return marked


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """The rows of `df` with a new text and the columns n_lines, n_deleted and deleted_lines.

    A run of lines that occurs before (in an earlier document by id, or higher up in the same one) and has
    `min_chars` characters or more is deleted; other lines stay as they are, byte for byte. Lines are equal
    if they are so without outer blanks. Null texts stay null, with no lines; empty ones have one line, that
    never goes. Texts of any length are taken whole. Rows with the same id and text are one document and lose
    the same lines; of one id's different texts the order is that of a hash; a null id comes first. Ids
    that are not whole numbers are ordered as text. Columns of `df` that bear the names of the three added
    ones are replaced; others stay. Empty tables stay empty.
    """
    added = ("n_lines", "n_deleted", "deleted_lines")
    gone = repeated_lines(df.select(_key(df, id_col).alias("d"), F.col(text_col).alias("text")), min_chars)
    gone = gone.select(F.col("d").alias("__d"), F.col("t").alias("__t"), F.col("gone").alias("__gone"))
    text, names = F.col(text_col), [c for c in df.columns if c not in added]
    keyed = df.select(*names, _key(df, id_col).alias("__d"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("__t"))
    lines = F.split(text, "\n", -1)
    # kept pieces: the lines before, between and after the deleted ones
    starts, stops = F.concat(F.array(F.lit(0)), F.transform("__gone", lambda x: x + 1)), F.concat("__gone", F.array(F.size("__lines")))
    pieces = F.transform(F.arrays_zip(starts.alias("a"), stops.alias("b")), lambda p: F.slice("__lines", p["a"] + 1, p["b"] - p["a"]))
    rest = F.array_join(F.flatten(pieces), "\n")
    # the list of deleted lines grows with the corpus: never broadcast
    out = keyed.join(gone.hint("merge"), ["__d", "__t"], "left").withColumn("__lines", F.when(F.col("__gone").isNotNull(), lines))
    lost = F.col("__gone").isNotNull()
    new = {text_col: F.when(lost, rest).otherwise(text), "n_lines": F.when(text.isNull(), 0).otherwise(F.size(lines)), "n_deleted": F.when(lost, F.size("__gone")).otherwise(0), "deleted_lines": F.coalesce("__gone", F.expr("cast(array() as array<int>)"))}
    return out.select(*[new[c].alias(c) if c == text_col else F.col(c) for c in names], *[new[c].alias(c) for c in added])
