"""The lake: partitioned Parquet tables, snapshots, raw archives, lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where none is set and Spark is one local process (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark.sparkContext, "_tallyfield_folder", None)
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tallyfield-")
        spark.sparkContext._tallyfield_folder = at  # the setting itself is fixed once a session runs
    return at.rstrip("/")


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, at: str | None = None) -> DataFrame:
    """Write to the shared folder and read again: what is used more than once is computed once."""
    spark = df.sparkSession
    at = at or new_folder(spark)
    df.write.option("compression", "zstd").parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._tallyfield_stored = at
    return out


def drop_stored(df: DataFrame) -> None:
    """Delete what `stored` wrote, once nothing reads it any more."""
    at = getattr(df, "_tallyfield_stored", None)
    if at:
        remove_folder(df.sparkSession, at)


def has_table(spark: SparkSession, path: str) -> bool:
    """Whether the folder exists and holds a row."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return False
    try:
        return not spark.read.parquet(path).isEmpty()
    except Exception as e:  # an existing folder without a data file
        if "UNABLE_TO_INFER_SCHEMA" in str(e):
            return False
        raise


def scan_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """All partitions; a missing table gives no rows if a schema is given."""
    if schema is not None and not has_table(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.option("mergeSchema", "true").parquet(path)


def write_partition(df: DataFrame, path: str, *columns: str) -> None:
    """Replace exactly the partitions that `df` has rows of; a rerun never appends."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*columns).parquet(path)


def write_by_year(df: DataFrame, path: str, day: str = "trade_date") -> None:
    write_partition(df.withColumn("year", F.year(day)), path, "year")


def latest_snapshot(spark: SparkSession, path: str, column: str = "built") -> DataFrame:
    """Rows of the newest snapshot; the subquery prunes the other partitions."""
    df = spark.read.parquet(path)
    top = df.agg(F.max(column).alias("top"))
    return df.join(F.broadcast(top), F.col(column) == F.col("top")).drop("top")  # one row


def archive_raw(spark: SparkSession, landing: str, manifest: str, source: str) -> DataFrame:
    """Landed files that the manifest does not know by content yet; appends them to it."""
    files = spark.read.format("binaryFile").load(landing).select("path", "length", F.sha2("content", 256).alias("sha256")).withColumn("source", F.lit(source))
    if has_table(spark, manifest):
        files = files.join(spark.read.parquet(manifest).select("source", "path", "sha256"), ["source", "path", "sha256"], "left_anti")
    new = stored(files.select("source", "path", "sha256", "length"))  # what was new stays so once the manifest has it
    new.write.mode("append").parquet(manifest)
    return new


def add_lineage(df: DataFrame, file_id: str, sha256: str, version: str) -> DataFrame:
    return df.withColumns({"_source_file_id": F.lit(file_id), "_sha256": F.lit(sha256), "_ingested_at": F.current_timestamp(), "_pipeline_version": F.lit(version)})


def fingerprint_header(line):
    """First 16 hex digits of the normalised header's SHA-256."""
    cells = F.transform(F.split(F.regexp_replace(line, "^﻿", ""), ","), lambda x: F.trim(x))
    return F.substring(F.sha2(F.concat_ws(",", cells), 256), 1, 16)


def stitch_sources(old: DataFrame, new: DataFrame, cut: str, day: str = "trade_date") -> DataFrame:
    """Old rows before the cut and new ones from it on, tagged."""
    return old.where(F.col(day) < cut).withColumn("source", F.lit("old")).unionByName(new.where(F.col(day) >= cut).withColumn("source", F.lit("new")))


def report_table(df: DataFrame, path: str) -> None:
    """One JSON document per row."""
    df.write.mode("overwrite").json(path)
