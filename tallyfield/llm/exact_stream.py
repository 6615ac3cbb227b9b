"""Exact deduplication as a stream with keyed state that never expires.

The stream groups documents by the SHA-256 digest of their normalised text. Its state, kept on disk by
RocksDB and in the checkpoint, holds per digest the smallest id, that row's content locator (file and row
number) and the number of rows seen; partial aggregation before the shuffle keeps a group of copies of any
size to one row per task. Rows whose digest is shared are then compared in full with the text that the
locator points to; should two different texts ever share a digest, the exact texts decide.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, remove, shared_dir

_ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores
}
#: Runs of blanks other than one plain space; only these change.
_RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: str = "text"):
    """Each run of blanks becomes one space; null is empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), _RUNS, " ")


def digest_state(spark: SparkSession, stream: DataFrame, key, state_dir: str, max_rows_per_trigger: str | None = None) -> DataFrame:
    """Run the stream to the end of its input; returns (digest, keep_id, file, at, seen, named) per digest.

    `stream` is a streaming DataFrame with doc_id and text; `key` maps it to the digest column. A later
    run with the same `state_dir` goes on from the stored state.
    """
    seen = stream.select(key.alias("digest"), "doc_id", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    named = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "file", "at"))
    state = seen.groupBy("digest").agg(F.min(named).alias("first"), F.count("*").alias("seen"), F.count("doc_id").alias("named"))
    results = f"{state_dir}/results"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").option("compression", "zstd").parquet(f"{results}/batch={number}")

    before = {k: spark.conf.get(k, None) for k in _ROCKS}
    try:
        for k, v in _ROCKS.items():
            spark.conf.set(k, v)
        query = state.writeStream.outputMode("update").option("checkpointLocation", f"{state_dir}/checkpoint").foreachBatch(keep).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    updates = spark.read.option("basePath", results).parquet(results)
    last = updates.groupBy("digest").agg(F.max_by(F.struct("first", "seen", "named"), "batch").alias("x"))
    return last.select("digest", F.col("x.first.doc_id").alias("keep_id"), F.col("x.first.file").alias("file"), F.col("x.first.at").alias("at"), "x.seen", "x.named")


def exact_duplicates(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", digest=None, state_dir: str | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, locator) of every row of the Parquet table at `path`.

    Of equal normalised texts the row with the smallest id stays. Null texts are empty texts and equal
    one another; texts of any length are compared whole. A row without an id never stays while its group has
    an id; a group of such rows alone has keep_id null and keeps them all. Rows that repeat an id are counted
    each, and all of those with the group's smallest id (ties) are kept. `locator` is the file and the row
    number of the text that stays. `digest` (a function from the normalised text to a column) can be weakened in tests: full
    comparison then splits the groups. An empty table gives no rows. Columns other than the two named are not
    read, whatever their names.
    """
    hashed = digest or (lambda t: F.sha2(t, 256))
    schema = spark.read.parquet(path).select(id_col, text_col).schema
    fixed = [F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")]
    # a glob of one name: a stream's path is otherwise taken for a folder, and the table may be one file
    stream = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]").select(*fixed, "_metadata")
    folder = state_dir or f"{shared_dir(spark)}/exact-{uuid.uuid4().hex}"
    # as tables of their own, so that joins have an exchange on either side and Spark can split a large group's rows
    state = materialize(digest_state(spark, stream, hashed(normalised()), folder), "state")
    source = spark.read.schema(schema).parquet(path)
    rows = source.select(*fixed)
    table = materialize(rows.select("doc_id", hashed(normalised()).alias("digest"), F.sha2(normalised(), 256).alias("text_sha256")), "digests")
    shared = state.where("seen > 1")
    # every hit's full bytes against those of the row that the locator names, large groups in salted parts
    hits = shared.where("seen = named").select("digest", F.col("file").alias("file1"), F.col("at").alias("at1"), F.ceil(F.col("seen") / 64).cast("int").alias("salts"))
    bodies = source.select(*fixed, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    bodies = bodies.select("file", "at", hashed(normalised()).alias("digest"), normalised().alias("body"))
    pieces = bodies.join(hits, "digest").withColumn("first", (F.col("file") == F.col("file1")) & (F.col("at") == F.col("at1"))).select("digest", "body", "first", "salts", F.pmod(F.xxhash64("file", "at"), F.col("salts")).cast("int").alias("salt"))
    pieces = materialize(pieces, "hits")
    held = pieces.where("not first").select("digest", "body", "salt")
    first = pieces.where("first").select("digest", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("body").alias("first_body"))
    odd = held.join(first, ["digest", "salt"]).where("body <> first_body").select("digest")
    odd = materialize(odd.union(shared.where("seen > named").select("digest")).distinct(), "collisions")
    discard(pieces)
    locator = F.concat_ws("#", "file", F.col("at").cast("string")).alias("locator")
    plain = table.join(state, "digest", "left").select("doc_id", "digest", "keep_id", F.col("seen").alias("group_size"), "text_sha256", locator)
    if odd.isEmpty():
        out = plain
    else:  # different texts under one digest, or rows without an id: the texts themselves are the groups
        split = rows.select("doc_id", hashed(normalised()).alias("digest"), normalised().alias("body")).join(odd, "digest", "left_semi")
        groups = materialize(split.groupBy("body").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).select(F.sha2("body", 256).alias("text_sha256"), "keep_id", "group_size"), "groups")
        own = table.join(odd, "digest", "left_semi").join(groups, "text_sha256").select("doc_id", "digest", "keep_id", "group_size", "text_sha256", F.lit(None).cast("string").alias("locator"))
        out = plain.join(odd, "digest", "left_anti").unionByName(own)
    out = out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "locator")
    out = materialize(out, "exact-duplicates")
    for x in (state, table, odd):
        discard(x)
    if state_dir is None:
        remove(spark, folder)
    return out
