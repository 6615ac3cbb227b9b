"""The queries of the corpus operators, op11 to op13 from structure_queries: each applies its operator to whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import structure_queries
from .byte_bpe import bpe_round_trip
from .common import discard, table
from .exact_stream import exact_duplicates
from .html_layout import render_pages
from .line_runs import line_dedup
from .quality_rff import quality_scores
from .secret_links import secret_spans
from .sketch_dedup import near_duplicates
from .source_mix import mix_sources
from .telephony import read_audio, store_audio
from .toxic_knn import toxicity_scores


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = store_audio(table(spark, sf_dir, "documents"))
    out = read_audio(media).drop("pcm")  # all of it has been read and stored by now
    discard(media)
    return out


def op3_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))


def op4_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = render_pages(table(spark, sf_dir, "pages"))
    return out.withColumns({"n_chars": F.length("text").cast("long"), "n_lines": F.size(F.split("text", "\n", -1)).cast("long")})


def op5_toxicity_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_deleted", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), F.array_join("deleted_lines", ",").alias("deleted_lines"))


def op7_quality_rff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern=public_tokenizers.PATTERN)


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mix_sources(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), F.array_join(F.transform("draws", lambda d: d["shard"].cast("string")), ",").alias("shards"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark, f"{sf_dir}/documents.parquet").drop("locator")


_OP10 = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash_near_dedup": op1_minhash_near_dedup,
        "op2_telephony": op2_telephony,
        "op3_secret_links": op3_secret_links,
        "op4_html_layout": op4_html_layout,
        "op5_toxicity_knn": op5_toxicity_knn,
        "op6_line_dedup": op6_line_dedup,
        "op7_quality_rff": op7_quality_rff,
        "op8_byte_bpe": op8_byte_bpe,
        "op9_source_mix": op9_source_mix,
        "op10_exact_dedup": op10_exact_dedup,
    } | structure_queries.queries()


def oracle_sql() -> dict[str, str]:
    return {"op10_exact_dedup": _OP10} | structure_queries.oracle_sql()
