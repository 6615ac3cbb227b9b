"""Queries of the ingest contract and the archive: a price file for each month of the bars, in two batches.

The second batch repeats the files of even months, publishes January, May and September anew (a share more each), and mends
March. In the first batch May and November have an unknown header, and March of even years and June of odd years
have a negative volume; June stays as it is.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import ingest as ig
from ..catalog import register
from ..lake import fingerprint_header, stored
from . import fixtures as fx
from .sqltext import with_views

HEADER, OTHER = "company_id,trade_date,close,volume", "ISIN,trade_date,close,volume"


def monthly_files(s, d):
    """(batch, source, key, name, content, seen) of both batches."""
    bars = fx.bars(s, d).select("company_id", "trade_date", "close", F.col("volume").cast("long").alias("volume"))
    month, year = F.month("trade_date"), F.year("trade_date")
    both = bars.withColumn("batch", F.explode(F.array(F.lit(1), F.lit(2))))
    bad = ((month == 3) & (year % 2 == 0) & (F.col("batch") == 1)) | ((month == 6) & (year % 2 == 1))
    both = both.where((F.col("batch") == 1) | (month % 2 == 0) | (month % 4 == 1) | (month == 3))
    volume = F.when(bad, -F.col("volume")).when((F.col("batch") == 2) & (month % 4 == 1), F.col("volume") + 1).otherwise(F.col("volume"))
    line = F.concat_ws(",", "company_id", F.col("trade_date").cast("string"), F.col("close").cast("string"), volume.cast("string"))
    header = F.when((F.col("batch") == 1) & (F.col("m") % 6 == 5), OTHER).otherwise(HEADER)
    files = both.groupBy("batch", F.date_format("trade_date", "yyyy-MM").alias("key"), month.alias("m")).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    content = F.array_join(F.concat(F.array(header), "lines"), "\n").cast("binary")
    return files.select("batch", F.lit("bars").alias("source"), "key", F.concat("key", F.lit(".csv")).alias("name"), content.alias("content"), F.col("batch").cast("long").alias("seen"))


def feed(s):
    cells = lambda line: F.split(line, ",")
    known = s.range(1).select(fingerprint_header(F.lit(HEADER))).first()[0]
    read = lambda line: {
        "company_id": F.get(cells(line), F.lit(0)), "trade_date": F.get(cells(line), F.lit(1)).try_cast("date"),
        "close": F.get(cells(line), F.lit(2)).try_cast("double"), "volume": F.get(cells(line), F.lit(3)).try_cast("long"),
    }
    return ig.Feed((known,), read, (("negative_volume", "BLOCK", F.col("volume") < 0), ("thin", "WARN", F.col("volume") < 10)))


def both_batches(s, d):
    root, files = ig.new_root(s), stored(monthly_files(s, d))
    for batch in (1, 2):
        ig.ingest(files.where(F.col("batch") == batch).drop("batch"), root, feed(s))
    return root


def silver(s, d):
    rows = ig.published(s, both_batches(s, d))
    return rows.groupBy(F.col("key").cast("string").alias("key")).agg(F.count("*").alias("n"), F.sum("volume").alias("volume"), F.max("_run").alias("run"))


def manifest_counts(s, d):
    return ig.manifest(s, both_batches(s, d)).groupBy("run", "status").agg(F.count("*").alias("files"), F.sum("rows").alias("rows"))


def blocks(s, d):
    return ig.open_blocks(s, both_batches(s, d)).select("key", "rule", "n", "run")


MONTHS = with_views("bars") + """, b AS (
  SELECT strftime(trade_date, '%Y-%m') AS key, month(trade_date) AS m, year(trade_date) AS y, count(*) AS n, CAST(sum(CAST(volume AS BIGINT)) AS BIGINT) AS v
  FROM bars GROUP BY ALL),
f AS (
  SELECT 1 AS run, key, m, y, n, CASE WHEN m % 6 = 5 THEN 'format_changed' WHEN (m = 3 AND y % 2 = 0) OR (m = 6 AND y % 2 = 1) THEN 'negative_volume' END AS block, FALSE AS same FROM b
  UNION ALL
  SELECT 2, key, m, y, n, CASE WHEN m = 6 AND y % 2 = 1 THEN 'negative_volume' END, m % 2 = 0 OR (m = 3 AND y % 2 = 1) FROM b WHERE m % 2 = 0 OR m % 4 = 1 OR m = 3),
st AS (SELECT *, CASE WHEN block IS NOT NULL THEN 'quarantined' WHEN same THEN 'skipped' ELSE 'loaded' END AS status FROM f)
"""
register("c05_ingest_partition", silver, MONTHS + """
SELECT key, b.n, CAST(CASE WHEN b.m % 4 = 1 THEN v + b.n ELSE v END AS BIGINT) AS volume, CAST(max(run) AS BIGINT) AS run
FROM b JOIN st USING (key) WHERE status = 'loaded' GROUP BY key, b.n, b.m, v""")
register("c05_ingest_manifest", manifest_counts, MONTHS + """
SELECT CAST(run AS BIGINT) AS run, status, count(*) AS files, CAST(sum(CASE WHEN status = 'loaded' THEN n ELSE 0 END) AS BIGINT) AS rows FROM st GROUP BY 1, 2""")
register("c05_open_blocks", blocks, MONTHS + """
SELECT key, block AS rule, CASE WHEN block = 'format_changed' THEN 1 ELSE n END AS n, CAST(min(run) AS BIGINT) AS run
FROM st WHERE block IS NOT NULL AND key NOT IN (SELECT key FROM st WHERE status = 'loaded') GROUP BY ALL""")


def archive_audit(s, d):
    """How many objects the first batch brings, the second one adds, and a scan finds changed after every February's bytes were cut short."""
    path, files = ig.new_root(s), stored(monthly_files(s, d))
    first = ig.archive(files.where("batch = 1").drop("batch"), path)
    second = ig.archive(files.drop("batch"), path)
    whole = ig.tampered(s, path)
    cut = ig.new_root(s)
    short = F.when(F.col("key").endswith("-02"), F.expr("substring(content, 1, 10)")).otherwise(F.col("content"))
    s.read.parquet(path).withColumn("content", short).write.partitionBy("source").parquet(cut)
    count = lambda df, what: df.agg(F.count("*").alias("objects")).withColumn("what", F.lit(what))
    return count(first, "kept").unionByName(count(second, "beside")).unionByName(count(whole, "changed")).unionByName(count(ig.tampered(s, cut), "changed_later"))


register("s06_archive_audit", archive_audit, MONTHS + """
SELECT 'kept' AS what, count(*) AS objects FROM b
UNION ALL SELECT 'beside', count(*) FROM b WHERE m % 4 = 1 OR (m = 3 AND y % 2 = 0)
UNION ALL SELECT 'changed', 0 UNION ALL SELECT 'changed_later', count(*) FROM b WHERE m = 2""")
