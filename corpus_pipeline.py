"""From raw documents to token counts: quality, line dedup, near-dedup, source mix, tokens.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last
return the columns of `documents` (any other columns pass through too, whatever their names). A document is
what its id and its text say: rows are matched by both, null-safe, so that texts which repeat an id, or
have none, are never mixed up, multiplied or lost.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.llm.byte_bpe import bpe_round_trip
from tallyfield.llm.common import discard, materialize, recorded, table
from tallyfield.llm.line_runs import line_dedup
from tallyfield.llm.quality_rff import quality_scores
from tallyfield.llm.sketch_dedup import near_duplicates
from tallyfield.llm.source_mix import mix_sources, mixed_rows

#: Documents with a lower calibrated probability of good quality are rejected.
LEAST_QUALITY = 0.5


def _hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _matched(docs: DataFrame, keyed: DataFrame, how: str) -> DataFrame:
    """`docs` joined with rows keyed by (__id, __hash)."""
    return docs.join(keyed, docs["doc_id"].eqNullSafe(keyed["__id"]) & (_hash() == keyed["__hash"]), how)


def _once(docs: DataFrame) -> DataFrame:
    """`docs` with one row of those that are equal in id and text; almost always there is nothing to do."""
    several = materialize(docs.groupBy(F.col("doc_id").alias("__id"), _hash().alias("__hash")).count().where("count > 1").drop("count"), "repeats")
    if several.isEmpty():
        return docs
    rest = _matched(docs, several, "left_semi").withColumn("__hash", _hash()).dropDuplicates(["doc_id", "__hash"]).drop("__hash")
    return _matched(docs, several, "left_anti").unionByName(rest)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts: calibrated score of LEAST_QUALITY or more.

    Null and empty texts are scored like any other, and texts of any length whole. Rows that repeat an id are
    judged by their own texts; equal rows (ties) share their fate. Without labels all scores are 0.5 and
    everything stays. An empty table stays empty.
    """
    scores = quality_scores(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    bad = scores.where(F.col("score") < LEAST_QUALITY).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    return _matched(docs, bad, "left_anti").select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated line runs; those of which only blanks are left go.

    Null, empty and blank texts that lose no line stay as they are. Texts of any length are read whole. Equal rows (ties) lose
    the same lines, whichever comes first; rows that repeat an id are documents of their own. n_chars follows the new text. An empty table stays empty.
    """
    out = line_dedup(docs.select("*", F.struct(*[F.col(c) for c in docs.columns]).alias("__row")))
    out = out.where((F.col("n_deleted") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.col("text"), "n_chars": F.when(F.col("n_deleted") == 0, F.col("__row.n_chars")).otherwise(F.length("text").cast("long"))}
    return out.select(*[new.get(c, F.col("__row")[c]).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id, null ids last, then the smallest text hash.

    Null, empty and blank texts are no one's duplicates and stay, but rows equal in id and text (repeats) are
    one document, of which one row stays. Texts of any length are compared whole. An empty table stays empty.
    """
    keyed = _once(docs).select("*", F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("__id"), _hash().alias("__hash")).alias("__key"))
    gone = near_duplicates(keyed, id_col="__key").where("not kept").select("doc_id.__id", "doc_id.__hash")
    return _matched(keyed, gone, "left_anti").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix uses them, dealt to shards and shuffled there.

    Null and empty texts fill no gap: they come along in whole passes only. Texts of any length are used whole. Rows equal in id and text
    are one document; rows that repeat an id with other texts are drawn each for itself; null ids likewise. A null source is a source. An
    empty table stays empty.
    """
    once = _once(docs)
    draws = mix_sources(once.select("doc_id", "text", "source")).where(F.size("draws") > 0)
    draws = draws.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("draws").alias("__draws"))
    used = _matched(once, draws, "inner").select(*docs.columns, "__draws")
    return mixed_rows(used, "__draws").select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row: one for each row of `docs`, repeats and null ids included.

    Null and empty texts have no token; texts of any length are encoded whole. An empty table stays empty.
    """
    return bpe_round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern=public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("line_dedup", lines),
    ("near_dedup", near_dedup),
    ("source_mix", mix),
    ("byte_bpe", tokens),
]
#: The classifier, the sketches and the tokens are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; of the tables written on the way only the last stage's input stays."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        with recorded() as tables:
            docs = materialize(stage(spark, before, sf_dir), name)
        for t in (before, *tables[:-1]):
            discard(t)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
