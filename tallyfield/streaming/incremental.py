"""Incremental versions of the batch steps on Structured Streaming; availableNow runs give batch results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lake import write_partition


def source(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, one file or a folder of them, as a stream (the glob names one path)."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run the stream over what is there, then read what it wrote; updates are overwritten batch by batch."""
    if mode == "append":
        query = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    else:
        # a complete result replaces the one before; updates of one run are disjoint but for late batches
        keep = lambda df, n: df.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={n}")
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(out)


def land_partitions(stream: DataFrame, table: str, checkpoint: str, column: str) -> None:
    """Each batch replaces the partitions it brings; a restart goes on behind the last finished batch."""
    stream.writeStream.foreachBatch(lambda df, n: write_partition(df, table, column)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def last_good_keys(stream: DataFrame) -> DataFrame:
    """Forward-only watermark per source: the greatest key that succeeded."""
    return stream.where("status = 'success'").groupBy("source_id").agg(F.max("partition_key").alias("last_good"))


def late_tolerant(stream: DataFrame, time: str = "ts", delay: str = "10 days") -> DataFrame:
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def deduplicated_alerts(stream: DataFrame, delay: str = "10 days") -> DataFrame:
    """First alert of each key within the delay."""
    return late_tolerant(stream, delay=delay).dropDuplicatesWithinWatermark(["dedupe_key"])


def weekly_counts(stream: DataFrame, delay: str = "10 days") -> DataFrame:
    """Alerts per kind and week starting on Monday."""
    w = F.window("ts", "7 days", startTime="4 days")  # the epoch was a Thursday
    return late_tolerant(stream, delay=delay).groupBy(w, "kind").agg(F.count("*").alias("n")).select(F.col("window.start").alias("week"), "kind", "n")


def exit_watch(closes: DataFrame, holdings: DataFrame, gain: float = 0.1, loss: float = 0.1) -> DataFrame:
    """Stream of closes against static holdings: which rule each new close meets."""
    j = closes.join(holdings, "company_id")
    rule = F.when(F.col("close") >= F.col("cost") * (1 + gain), "target").when(F.col("close") <= F.col("cost") * (1 - loss), "stop")
    return j.withColumn("rule", rule).where("rule is not null")


def first_publications(stream: DataFrame) -> DataFrame:
    return stream.groupBy("company_id", "period_to").agg(F.min("published_at").alias("published_at"))


def daily_bars(ticks: DataFrame, delay: str = "1 day") -> DataFrame:
    """Open, high, low, close and count per type and day of a tick stream."""
    at = F.struct("ts", "event_id")
    w = F.window("ts", "1 day")
    out = late_tolerant(ticks, delay=delay).groupBy(w, "event_type").agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count("*").alias("n"))
    return out.select(F.col("window.start").cast("date").alias("day"), "event_type", "open", "high", "low", "close", "n")
