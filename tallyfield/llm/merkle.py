"""Merkle trees over sections, paragraphs and pieces of texts, in DataFrame functions only.

A text is split into sections at empty lines, a section into paragraphs at line ends, and a paragraph into
pieces: up to 64 characters that end behind the end of a sentence, a space, or the last character. All splits
keep every character, so equal trees mean equal texts. The digest of a piece is that of its characters, the
digest of any branch that of its children's digests. Roots test equality; where they differ, the walk down the
branches that differ locates the edits.

A fingerprint is written as root:tree. The tree has eight hexadecimal digits of every piece, `,` between the pieces
of a paragraph, `;` between paragraphs, `|` between sections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

#: A piece: to the end of a sentence, else to a space or the end, else PIECE characters; nothing lies between pieces.
PIECE = 64
PIECES = rf"(?s)[^.!?]{{0,{PIECE}}}[.!?]+\x20*|[^.!?]{{1,{PIECE}}}(?:\x20|\z)|[^.!?]{{{PIECE}}}"


def _digest(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def _branch(children: Column) -> Column:
    return _digest(F.array_join(children, ","))


def fingerprint(text: Column) -> Column:
    """root:tree of a text; null counts as empty."""
    pieces = lambda p: F.transform(F.regexp_extract_all(p, F.lit(PIECES), F.lit(0)), _digest)
    leaves = F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n", -1), lambda s: F.transform(F.split(s, "\n", -1), pieces))
    root = lambda t: _branch(F.transform(t, lambda s: _branch(F.transform(s, _branch))))
    short = lambda p: F.array_join(F.transform(p, lambda d: F.substring(d, 1, 8)), ",")
    tree = lambda t: F.array_join(F.transform(t, lambda s: F.array_join(F.transform(s, short), ";")), "|")
    return F.transform(F.array(leaves), lambda t: F.concat(root(t), F.lit(":"), tree(t)))[0]


def _root(f: Column) -> Column:
    return F.substring(f, 1, 64)


def _tree(f: Column) -> Column:
    return F.substring(f, 66, 2**31 - 1)


def likeness(a: Column, b: Column) -> Column:
    """Twice the distinct pieces that two fingerprints share over the sum of their distinct pieces (Dice); 1 where the roots are equal."""
    pieces = lambda f: F.array_distinct(F.split(F.translate(_tree(f), "|;", ",,"), ","))
    dice = lambda x, y: 2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))
    share = F.transform(F.array(F.struct(pieces(a).alias("a"), pieces(b).alias("b"))), lambda s: dice(s["a"], s["b"]))[0]
    return F.when(_root(a) == _root(b), F.lit(1.0)).otherwise(share)


def first_edit(old: Column, new: Column, backwards: bool = False) -> Column:
    """section.paragraph.piece (from 0) of the first branch of `new` that differs from that of `old` in the same place; null where the roots are equal.

    A walk down from the root: at every level only the first branch that differs is opened. A branch that one of the
    trees lacks ends the path. `backwards` counts branches from the end, and so finds the last edit.
    """
    turned = F.reverse if backwards else lambda x: x
    path, a, b = [], _tree(old), _tree(new)
    for between in (r"\|", ";", ","):
        a, b = turned(F.split(a, between, -1)), turned(F.split(b, between, -1))
        at = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False).cast("int") - 1
        path.append(at.cast("string"))
        a, b = F.get(a, at), F.get(b, at)
    return F.when(_root(old) != _root(new), F.concat_ws(".", *path))


def with_next(rows: DataFrame, id_col: str, tie_col: str, field: str, derived: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """`rows` with the columns `derived`, and with next_<column> of `field` and of these from the row that comes next by descending id
    (nulls last), after the last from the first; and the table this reads, to be discarded.

    Rows are dealt to ranges of the order, so none holds more than its share; each range gets a copy of the next range's
    first row as its end, and a window within the range does the rest. Columns are derived behind the exchange, once for
    each row. Of the ranges the driver sees numbers only.
    """
    spark = rows.sparkSession
    order = [F.col(id_col).desc_nulls_last(), F.col(tie_col).desc(), F.col("__row").desc()]
    ranges = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id())
    ranged = materialize(ranged, "ranged")
    firsts = ranged.groupBy("__range").agg(F.max(F.struct(id_col, tie_col, "__row"))["__row"].alias("row")).orderBy("__range").collect()
    links = [(r["__range"], r["row"], firsts[i - 1]["__range"]) for i, r in enumerate(firsts)]
    ends = ranged.join(F.broadcast(spark.createDataFrame(links, "__range int, __row long, __before int")), ["__range", "__row"])
    ends = ends.withColumn("__range", F.col("__before")).drop("__before")
    window = Window.partitionBy("__range").orderBy("__end", *order)
    both = ranged.withColumn("__end", F.lit(0)).unionByName(ends.withColumn("__end", F.lit(1)))
    out = both.withColumn(f"next_{field}", F.lead(field).over(window)).withColumns(derived)
    out = out.withColumns({f"next_{c}": F.lead(c).over(window) for c in derived}).where("__end = 0").drop("__end", "__row", "__range")
    return out, ranged


def document_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, first_edit, last_edit) of every row of `df`.

    The edited text has the last half (rounded down) of the code points replaced by the first as many, or all, of the next
    document's. Null texts are empty; an empty text has one empty piece and is edited into itself. Texts of any length are
    fingerprinted whole. Null ids come last in the order; rows that repeat an id (ties) follow one another by their
    texts' hashes, and equal rows are neighbours. A single row comes next to itself. Other columns are not read,
    whatever their names; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("tie", F.xxhash64("text"))
    linked, ranged = with_next(rows, "doc_id", "tie", "text", {"fingerprint": fingerprint(F.col("text"))})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    out = linked.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
    out = out.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    out = out.select(
        "doc_id", "n_chars", _digest(F.col("edited")).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), "near_next",
        first_edit(F.col("fingerprint"), F.col("edited_fingerprint")).alias("first_edit"), first_edit(F.col("fingerprint"), F.col("edited_fingerprint"), True).alias("last_edit"),
    )
    out = materialize(out, "fingerprints")
    discard(ranged)
    return out
