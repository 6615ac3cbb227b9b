"""The ingest contract: stops between steps, repeats, re-publications, blocks, archive; and identity over time."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyfield import ingest as ig
from tallyfield.lake import fingerprint_header
from tallyfield.operators import graph, identity

D = dt.date
HEADER = "k,v"


@pytest.fixture(scope="module")
def feed(spark):
    known = spark.range(1).select(fingerprint_header(F.lit(HEADER))).first()[0]
    read = lambda line: {"k": F.get(F.split(line, ","), F.lit(0)), "v": F.get(F.split(line, ","), F.lit(1)).try_cast("long")}
    return ig.Feed((known,), read, (("negative", "BLOCK", F.col("v") < 0), ("zero", "WARN", F.col("v") == 0)))


def files(spark, *rows):
    return spark.createDataFrame([("s", k, f"{k}.csv", None if text is None else bytearray(text.encode()), seen) for k, text, seen in rows], "source string, key string, name string, content binary, seen long")


def silver(spark, root):
    return sorted((r.key, r.k, r.v) for r in ig.published(spark, root).select(F.col("key").cast("string").alias("key"), "k", "v").collect())


def states(spark, root):
    return sorted((r.run, r.key, r.status, r.rows) for r in ig.manifest(spark, root).collect())


def test_contract(spark, feed, tmp_path):
    root = str(tmp_path / "lake")
    first = files(spark, ("d1", "k,v\na,1\nb,2\n", 1), ("d2", "k,v\na,-1", 1), ("d3", "x,v\na,1", 1), ("d4", None, 1), ("d5", "k,v\n", 1), ("d6", "k,v\na,zzz\nb,0", 1))
    assert ig.ingest(first, root, feed) == 1
    assert silver(spark, root) == [("d1", "a", 1), ("d1", "b", 2), ("d6", "a", None), ("d6", "b", 0)]
    assert states(spark, root) == [(1, "d1", "loaded", 2), (1, "d2", "quarantined", 0), (1, "d3", "quarantined", 0), (1, "d4", "quarantined", 0), (1, "d5", "quarantined", 0), (1, "d6", "loaded", 2)]
    assert {(r.key, r.rule) for r in ig.open_blocks(spark, root).collect()} == {("d2", "negative"), ("d3", "format_changed"), ("d4", "format_changed"), ("d5", "no_rows")}
    # the same bytes are skipped, or blocked again without a second issue; a mended file resolves its block, a new publication replaces
    again = files(spark, ("d1", "k,v\na,1\nb,2\n", 2), ("d3", "x,v\na,1", 2), ("d2", "k,v\na,5", 2), ("d6", "k,v\na,7", 2), ("d6", "k,v\na,-7", 3))
    assert ig.ingest(again, root, feed) == 2
    assert silver(spark, root) == [("d1", "a", 1), ("d1", "b", 2), ("d2", "a", 5), ("d6", "a", 7)]
    assert [x[1:3] for x in states(spark, root) if x[0] == 2] == [("d1", "skipped"), ("d2", "loaded"), ("d3", "quarantined"), ("d6", "loaded"), ("d6", "quarantined")]
    assert spark.read.parquet(f"{root}/quarantine").where("key = 'd3'").count() == 1
    assert {r.key for r in ig.open_blocks(spark, root).collect()} == {"d3", "d4", "d5"}
    # an older publication comes back only by force
    assert ig.ingest(files(spark, ("d6", "k,v\na,zzz\nb,0", 4)), root, feed) == 3 and ("d6", "a", 7) in silver(spark, root)
    ig.ingest(files(spark, ("d6", "k,v\na,zzz\nb,0", 4)), root, feed, force=True)
    assert ("d6", "b", 0) in silver(spark, root)


def test_a_stop_between_any_two_steps_is_mended(spark, feed, tmp_path):
    before, batch = files(spark, ("d1", "k,v\na,1", 1)), files(spark, ("d1", "k,v\na,2", 2), ("d2", "k,v\nb,-3", 2), ("d3", "k,v\nc,4", 2))
    for stop in range(1, 5):
        root = str(tmp_path / f"lake{stop}")
        ig.ingest(before, root, feed)
        going = ig.steps(batch, root, feed, ig.next_run(spark, root))
        done = [next(going) for _ in range(stop)]
        assert done == ["archive", "stage", "audit", "publish"][:stop]
        going.close()
        assert len(states(spark, root)) == 1  # nothing of the batch is recorded
        ig.ingest(batch, root, feed)
        assert silver(spark, root) == [("d1", "a", 2), ("d3", "c", 4)]
        assert [x[1:3] for x in states(spark, root)] == [("d1", "loaded"), ("d1", "loaded"), ("d2", "quarantined"), ("d3", "loaded")]
        assert spark.read.parquet(f"{root}/quarantine").count() == 1
        assert spark.read.parquet(f"{root}/archive").count() == 4


def test_archive_names_objects_by_content(spark, tmp_path):
    path = str(tmp_path / "archive")
    assert ig.archive(files(spark, ("d", "one", 1), ("d", "one", 2)), path).count() == 1
    assert ig.archive(files(spark, ("d", "one", 3)), path).count() == 0
    assert ig.archive(files(spark, ("d", "two", 4), ("e", "one", 4)), path).count() == 2
    names = [r.object for r in spark.read.parquet(path).collect()]
    assert len(set(names)) == 3 and all(n[12:] in ("_d.csv", "_e.csv") for n in names) and ig.tampered(spark, path).count() == 0
    bad = spark.read.parquet(path).withColumn("content", F.when(F.col("key") == "e", F.lit(b"onf")).otherwise(F.col("content")))
    bad.write.partitionBy("source").parquet(str(tmp_path / "bad"))
    assert [(r.key, r.found != r.sha256) for r in ig.tampered(spark, str(tmp_path / "bad")).collect()] == [("e", True)]


def test_landed_files(spark, feed, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    (land / "2024-01-02.csv").write_text("k,v\na,1")
    got = ig.landed(spark, str(land), "s", F.regexp_extract("path", r"(\d{4}-\d\d-\d\d)", 1))
    assert got.select("source", "key", "name").first() == ("s", "2024-01-02", "2024-01-02.csv")
    ig.ingest(got, str(tmp_path / "lake"), feed)
    assert silver(spark, str(tmp_path / "lake")) == [("2024-01-02", "a", 1)]


def companies(spark, seen, moves):
    o = spark.createDataFrame(seen, "symbol string, first_seen date, last_seen date")
    c = spark.createDataFrame(moves, "old_symbol string, new_symbol string, change_date date")
    return {(r.symbol, r.valid_from): (r.company_id, r.valid_to, r.first_traded, r.last_traded) for r in identity.symbol_map(o, c).collect()}


def test_reused_symbols_are_companies_of_their_own(spark):
    start, end = D(1900, 1, 1), D(9999, 12, 31)
    got = companies(spark, [("OLD", D(2016, 1, 1), D(2026, 1, 1)), ("NEW", D(2019, 3, 1), D(2026, 1, 1)), ("PLAIN", D(2016, 1, 1), D(2016, 1, 1)), ("GONE", D(2016, 1, 1), D(2018, 1, 1))],
                    [("OLD", "NEW", D(2019, 3, 1)), ("GONE", "UNSEEN", D(2017, 1, 1)), ("NONE", "NONE2", D(2020, 1, 1)), ("PLAIN", "PLAIN", D(2020, 1, 1)), ("PLAIN", "OTHER", None)])
    assert got == {
        ("OLD", start): ("NEW", D(2019, 2, 28), D(2016, 1, 1), D(2019, 2, 28)), ("NEW", D(2019, 3, 1)): ("NEW", end, D(2019, 3, 1), D(2026, 1, 1)),
        ("OLD", D(2019, 3, 1)): ("OLD", end, D(2019, 3, 1), D(2026, 1, 1)), ("PLAIN", start): ("PLAIN", end, D(2016, 1, 1), D(2016, 1, 1)),
        ("GONE", start): ("GONE", D(2016, 12, 31), D(2016, 1, 1), D(2016, 12, 31)), ("GONE", D(2017, 1, 1)): ("GONE", end, D(2017, 1, 1), D(2018, 1, 1)),
    }


def test_a_name_taken_back_and_a_swap(spark):
    span = (D(2010, 1, 1), D(2025, 1, 1))
    got = companies(spark, [("A", *span), ("B", *span), ("C", *span)], [("A", "B", D(2015, 1, 1)), ("B", "A", D(2020, 1, 1)), ("B", "C", D(2020, 1, 1)), ("C", "B", D(2020, 1, 1))])
    at = lambda s, *d: got[s, D(*d)][0]
    assert at("A", 1900, 1, 1) == at("B", 2015, 1, 1) == at("A", 2020, 1, 1)  # renamed, and back
    assert at("C", 1900, 1, 1) == at("B", 2020, 1, 1)  # taken over in the swap
    assert at("A", 2015, 1, 1) not in {at("A", 1900, 1, 1)} and at("B", 1900, 1, 1) not in {at("B", 2015, 1, 1)}


def test_groups(spark):
    rows = [("a", "b"), ("c", "b"), ("x", "y"), ("q", "q")] + [(f"n{i:03}", f"n{i + 1:03}") for i in range(100)] + [("hub", f"s{i}") for i in range(50)]
    got = {r.node: r.head for r in graph.groups(spark.createDataFrame(rows, "u string, v string")).collect()}
    assert got["c"] == got["a"] == "a" and got["y"] == "x" and "q" not in got and {got[f"n{i:03}"] for i in range(101)} == {"n000"} and {got[f"s{i}"] for i in range(50)} == {"hub"}
    assert graph.groups(spark.createDataFrame([], "u string, v string")).count() == 0
