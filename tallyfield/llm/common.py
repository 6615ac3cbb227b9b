"""Shared helpers: shared-storage materialisation and batch slicing."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word-based operator: space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a Python task turns into numpy arrays at one time.
CHUNK_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; a temporary one only where none is set and Spark is one local process (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark.sparkContext, "_tallyfield_folder", None)
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tallyfield-")
        spark.sparkContext._tallyfield_folder = at  # the setting itself is fixed once a session runs
    return at.rstrip("/")


def materialize(df: DataFrame, name: str, level: int = 3) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage and survives lost executors. `level` is that of zstd."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level)).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tallyfield_path = path
    for tables in _RECORDS:
        tables.append(out)
    return out


_RECORDS: list[list[DataFrame]] = []


@contextmanager
def recorded() -> Iterator[list[DataFrame]]:
    """All tables that `materialize` writes inside the block, so that a caller can delete what operators had to leave."""
    tables: list[DataFrame] = []
    _RECORDS.append(tables)
    try:
        yield tables
    finally:
        _RECORDS.pop()


def discard(df: DataFrame | None) -> None:
    """Delete what `materialize` wrote, once nothing reads it any more."""
    path = getattr(df, "_tallyfield_path", None)
    if path:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narrow(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, under fixed names, so that other columns can't clash."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def slices(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(ids, UTF-8 bytes, offsets) of runs of rows of about `limit` bytes; a null text is empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, texts = batch.column(0), batch.column(1).cast(pa.large_string())
        if texts.null_count:
            texts = texts.fill_null("")
        ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(texts):
            to = int(np.searchsorted(ends, ends[at] + limit, "right")) - 1
            to = min(max(to, at + 1), len(texts), at + 60_000)
            yield ids.slice(at, to - at), data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
            at = to


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
