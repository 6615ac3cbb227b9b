"""From landed files to published partitions: archive, stage, audit, publish, record.

A batch of files, of any number of partitions, goes through five steps, each a Spark job that writes a table of its own:

1. `archive`: the executors store the files' bytes under their digest; bytes that are there already are left alone.
2. `stage`: files that were never loaded with these bytes are read into rows.
3. `audit`: unknown headers, unreadable rows and the feed's rules give issues; new ones are appended to the quarantine.
4. `publish`: of every partition, the last file without a blocking issue replaces what was published.
5. `record`: the manifest gets one row for each file.

The manifest comes last, and all that comes before can be repeated: after a stop between any two steps the next run does
the same again with the same result. A block counts as resolved once the manifest has a later load of its partition;
nothing has to be rewritten for that.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .lake import drop_stored, fingerprint_header, has_table, scan_table, stored, write_partition

FILE = ["source", "key", "sha256"]
_MANIFEST = "run long, source string, key string, name string, sha256 string, seen long, status string, rows long"
_ISSUES = "source string, key string, sha256 string, rule string, severity string, n long, run long"


@dataclass(frozen=True)
class Feed:
    """A kind of file: the fingerprints of its headers, how its lines become columns, and (rule, severity, condition of a bad row).

    `read` gets a line as a column and returns the row's columns; a row for which the first of them is null is unreadable.
    """

    headers: tuple[str, ...]
    read: Callable[[Column], dict[str, Column]]
    rules: tuple[tuple[str, str, Column], ...] = ()


def landed(spark: SparkSession, path: str, source: str, key: Column, seen: Column | None = None) -> DataFrame:
    """Files of a landing folder as (source, key, name, content, seen); `key` and `seen` are made from binaryFile's columns."""
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.lit(source).alias("source"), key.alias("key"), name.alias("name"), "content", (F.unix_millis("modificationTime") if seen is None else seen).alias("seen"))


def archive(files: DataFrame, path: str) -> DataFrame:
    """Stores the bytes that the archive doesn't have for their source and key, and returns (source, key, object, sha256, length) of these.

    An object is named by its digest and its file's name: another publication of the same key lies beside the first.
    """
    spark = files.sparkSession
    sha = F.sha2("content", 256)
    new = files.select("source", "key", "name", sha.alias("sha256"), F.length("content").cast("long").alias("length"), "content")
    if has_table(spark, path):
        new = new.join(spark.read.parquet(path).select(*FILE), FILE, "left_anti")
    once = Window.partitionBy(*FILE).orderBy("name")
    new = new.withColumn("nth", F.row_number().over(once)).where("nth = 1").withColumn("object", F.concat(F.substring("sha256", 1, 12), F.lit("_"), "name"))
    new = stored(new.select("key", "object", "sha256", "length", "content", "source"))
    new.write.mode("append").option("compression", "zstd").partitionBy("source").parquet(path)
    told = stored(new.select("source", "key", "object", "sha256", "length"))
    drop_stored(new)
    return told


def tampered(spark: SparkSession, path: str) -> DataFrame:
    """Objects of the archive whose bytes don't have the digest that names them: (source, key, object, sha256, found)."""
    rows = spark.read.parquet(path).withColumn("found", F.sha2("content", 256))
    return rows.where("found <> sha256 or length <> octet_length(content)").select("source", "key", "object", "sha256", "found")


def manifest(spark: SparkSession, root: str) -> DataFrame:
    return scan_table(spark, f"{root}/manifest", _MANIFEST)


def open_blocks(spark: SparkSession, root: str) -> DataFrame:
    """Blocking issues of partitions that no later run has loaded."""
    loads = manifest(spark, root).where("status = 'loaded'").groupBy("source", "key").agg(F.max("run").alias("loaded"))
    issues = scan_table(spark, f"{root}/quarantine", _ISSUES).where("severity = 'BLOCK'")
    return issues.join(loads, ["source", "key"], "left").where("loaded is null or loaded < run").drop("loaded")


def _todo(files: DataFrame, root: str, force: bool) -> DataFrame:
    """The files with what becomes of them: 'skipped' if these bytes were loaded before, else null."""
    known = manifest(files.sparkSession, root).where("status = 'loaded'").select(*FILE).distinct().withColumn("before", F.lit(True))
    out = files.withColumn("sha256", F.sha2("content", 256)).join(known, FILE, "left")
    return out.withColumn("skipped", F.lit(False) if force else F.coalesce("before", F.lit(False))).drop("before")


def _staged(todo: DataFrame, feed: Feed) -> DataFrame:
    """(source, key, sha256, seen, line, known, row columns): a row for each line behind the header, at least one for each file."""
    lines = F.split(F.regexp_replace(F.col("content").cast("string"), r"\r?\n\z", ""), r"\r?\n")
    files = todo.where("not skipped").select(*FILE, "seen", lines.alias("lines"))
    known = F.coalesce(fingerprint_header(F.get("lines", F.lit(0))).isin(*feed.headers), F.lit(False))
    files = files.select(*FILE, "seen", known.alias("known"), F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0))).alias("body"))
    # what is told of a file is worked out before its lines are spread, not once a line
    rows = files.select(*FILE, "seen", "known", F.posexplode_outer(F.when(F.col("known"), F.col("body"))).alias("line", "text"))
    return rows.select(*FILE, "seen", "known", "line", *[c.alias(n) for n, c in feed.read(F.col("text")).items()])


def _issues(staged: DataFrame, feed: Feed, columns: list[str]) -> DataFrame:
    """(source, key, sha256, rule, severity, n): one aggregation for all rules."""
    row = F.col("known") & F.col("line").isNotNull()
    checks = [
        ("format_changed", "BLOCK", ~F.col("known")), ("no_rows", "BLOCK", F.col("known") & F.col("line").isNull()),
        ("unreadable", "BLOCK", row & F.col(columns[0]).isNull()), *[(n, sev, row & F.coalesce(cond, F.lit(False))) for n, sev, cond in feed.rules],
    ]
    counts = staged.groupBy(*FILE).agg(*[F.count_if(cond).alias(n) for n, _, cond in checks])
    each = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(sev).alias("severity"), F.col(n).alias("n")) for n, sev, _ in checks])
    return counts.select(*FILE, F.explode(each).alias("i")).select(*FILE, "i.*").where("n > 0")


def steps(files: DataFrame, root: str, feed: Feed, run: int, force: bool = False) -> Iterator[str]:
    """Does one step for each `next`, and tells its name; `ingest` does them all. A stop in between leaves what the next run repeats."""
    spark = files.sparkSession
    files = files.withColumn("content", F.coalesce("content", F.lit(b"")))
    drop_stored(archive(files, f"{root}/archive"))
    yield "archive"
    todo = stored(_todo(files, root, force).select(*FILE, "name", "content", "seen", "skipped"))
    columns = list(feed.read(F.lit("")))
    staged = stored(_staged(todo, feed))
    yield "stage"
    issues = stored(_issues(staged, feed, columns))
    told = scan_table(spark, f"{root}/quarantine", _ISSUES).select(*FILE, "rule")
    issues.join(told, [*FILE, "rule"], "left_anti").withColumn("run", F.lit(run).cast("long")).write.mode("append").parquet(f"{root}/quarantine")
    yield "audit"
    blocked = issues.where("severity = 'BLOCK'").select(*FILE).distinct()
    clean = staged.where("known").join(blocked, FILE, "left_anti")
    last = clean.groupBy("source", "key").agg(F.max_by("sha256", F.struct("seen", "sha256")).alias("sha256"))
    rows = clean.join(last, FILE).withColumnsRenamed({"sha256": "_sha256"}).withColumns({"_run": F.lit(run).cast("long"), "_ingested_at": F.current_timestamp()})
    rows = rows.select(*columns, "_sha256", "_run", "_ingested_at", "source", "key").repartition("source", "key")
    if not last.isEmpty():
        write_partition(rows, f"{root}/published", "source", "key")
    yield "publish"
    counts = staged.groupBy(*FILE).agg(F.count("line").alias("rows"))
    state = todo.select(*FILE, "name", "seen", "skipped").join(counts, FILE, "left").join(blocked.withColumn("blocked", F.lit(True)), FILE, "left")
    status = F.when(F.col("skipped"), "skipped").when(F.col("blocked"), "quarantined").otherwise("loaded")
    state = state.select(F.lit(run).cast("long").alias("run"), "source", "key", "name", "sha256", "seen", status.alias("status"), F.when(status == "loaded", F.col("rows")).otherwise(0).cast("long").alias("rows"))
    state.write.mode("append").parquet(f"{root}/manifest")
    for table in (todo, staged, issues):
        drop_stored(table)
    yield "record"


def ingest(files: DataFrame, root: str, feed: Feed, force: bool = False) -> int:
    """Ingests (source, key, name, content, seen) and returns the run's number.

    Files whose bytes were loaded before are skipped unless `force`; of several files for a key in a batch the last
    `seen` without a blocking issue is published. A null content is an empty file.
    """
    run = next_run(files.sparkSession, root)
    for _ in steps(files, root, feed, run, force):
        pass
    return run


def next_run(spark: SparkSession, root: str) -> int:
    return (manifest(spark, root).agg(F.max("run")).first()[0] or 0) + 1


def published(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/published")


def new_root(spark: SparkSession) -> str:
    from .lake import shared_folder

    return f"{shared_folder(spark)}/lake-{uuid.uuid4().hex}"
