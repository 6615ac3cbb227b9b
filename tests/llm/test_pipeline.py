"""The pipeline's stages against plain Python, each on its own input with nulls, empties, repeats, ties, long texts and extra columns."""

import random
import re
from collections import Counter

import corpus_pipeline as cp
import public_tokenizers
import pytest
import tiktoken

from tallyfield.llm import byte_bpe
from tallyfield.llm.quality_rff import quality_scores

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score int, draws string, text_hash string"


def row(i, text, source="s", extra=0):
    return (i, text, "en", source, len(text or ""), extra, "d", "t")


BASE = " ".join(f"w{k}" for k in range(60))
LINE = "a passage that is long enough to be deleted where it repeats"
ROWS = [
    row(1, BASE), row(2, BASE + " end"), row(2, "quite another text of the same id"), row(3, BASE), row(3, BASE), row(None, "no id"), row(None, "no id"), row(None, BASE + " x"),
    row(4, None), row(5, ""), row(5, ""), row(6, " \t\n"), row(7, "intro\n" + LINE), row(8, LINE + " \t\nrest of it"), row(9, LINE), row(10, "y " * 20000, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    rng = random.Random(2)
    texts = [(100 + i, " ".join(rng.choice(["alpha", "beta", "of", "the"]) + ("!!!" if i % 2 else "") for _ in range(40))) for i in range(200)]
    spark.createDataFrame([(i, int("!" not in t), 0) for i, t in texts], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([row(i, t) for i, t in texts] + ROWS, SCHEMA).write.parquet(f"{at}/documents.parquet")
    return at


def pairs(df):
    assert set(df.columns) >= {"doc_id", "text"}
    return Counter((r.doc_id, r.text) for r in df.collect())


def own(rows):
    return Counter((r[0], r[1]) for r in rows)


def test_quality_rejects_by_text(spark, docs, sf):
    all_docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = cp.quality(spark, all_docs, sf)
    assert out.columns == all_docs.columns
    scores = {(r.doc_id, r.text_hash): r.score for r in quality_scores(all_docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    hashes = {(r.doc_id, r.text): r.h for r in all_docs.selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) as h").collect()}
    want = Counter({k: n for k, n in pairs(all_docs).items() if scores[k[0], hashes[k]] >= cp.LEAST_QUALITY})
    assert pairs(out) == want
    labelled = [(i, n) for (i, t), n in pairs(out).items() if i and i >= 100]
    assert len(labelled) == 100 and all(i % 2 == 0 for i, _ in labelled)
    empty = cp.quality(spark, docs.where("false"), sf)
    assert empty.count() == 0 and empty.columns == docs.columns


def test_lines_keep_first_copies(spark, docs, sf):
    out = cp.lines(spark, docs, sf)
    assert out.columns == docs.columns
    got = pairs(out)
    # null ids come first, then by id; of equal rows all lose alike; what has no line left goes
    assert got[8, "rest of it"] == 1 and got[9, LINE] == 0 and got[9, ""] == 0 and got[7, "intro\n" + LINE] == 1
    assert got[1, BASE] == 1 and got[3, BASE] == 0 and got[2, BASE + " end"] == 1 and got[None, "no id"] == 2 and got[4, None] == 1 and got[5, ""] == 2 and got[6, " \t\n"] == 1
    assert sum(got.values()) == len(ROWS) - 3
    assert {r.n_chars for r in out.where("doc_id = 8").collect()} == {len("rest of it")}
    assert cp.lines(spark, docs.where("false"), sf).count() == 0


def test_near_dedup_keeps_one_of_each_group(spark, docs, sf):
    out = cp.near_dedup(spark, docs, sf)
    assert out.columns == docs.columns
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    shingles = lambda t: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := words(t)) else set()
    once = sorted({(r[0] is None, r[0] or 0, r[1]) for r in ROWS}, key=lambda x: (x[0], x[1], x[2] or ""))
    group = list(range(len(once)))
    for a in range(len(once)):
        for b in range(a):
            x, y = shingles(once[a][2]), shingles(once[b][2])
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = group[a], group[b]
                group = [min(p, q) if g in (p, q) else g for g in group]
    want = Counter((None if none else i, t) for k, (none, i, t) in enumerate(once) if group[k] == k)
    assert pairs(out) == want and want[2, "quite another text of the same id"] == 1 and want[None, "no id"] == 1
    assert cp.near_dedup(spark, docs.where("false"), sf).count() == 0


def test_mix_neither_multiplies_nor_loses_rows(spark, docs, sf):
    rng = random.Random(4)
    rows = ROWS + [row(20 + i, " ".join(["w"] * rng.randint(1, 60)), f"s{i % 3}") for i in range(120)] + [row(None, f"n {i}", "s1") for i in range(20)]
    d = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = cp.mix(spark, d, sf)
    assert out.columns == d.columns
    got = pairs(out)
    assert set(got) <= set(own(rows)) and max(got.values()) <= 3
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    source = {(r[0], r[1]): r[3] for r in rows}
    have, taken = Counter(), Counter()
    for k in source:
        have[source[k]] += size(k[1])
        taken[source[k]] += size(k[1]) * got[k]
    weight = {s: 1 + n % 3 for n, s in enumerate(sorted(have, key=lambda s: (s is None, s or "")))}
    total, target, free = sum(have.values()), {}, set(have)
    while free:  # the targets stop at three times the size, the rest is shared again
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * have[s]}
        target |= {s: 3 * have[s] for s in over} if over else {s: level * weight[s] for s in free}
        free -= over or free
    smallest = {s: min(size(k[1]) for k in source if source[k] == s and size(k[1])) for s in have}
    assert all(abs(taken[s] - target[s]) <= max(smallest[s], 1) for s in have)
    assert pairs(cp.mix(spark, d.repartition(2), sf)) == got
    assert cp.mix(spark, docs.where("false"), sf).count() == 0


def test_tokens_and_whole_run(spark, docs, sf):
    out = cp.tokens(spark, docs, sf).collect()
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = byte_bpe.Ranks(f.read()).rank
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert Counter((r.doc_id, r.n_tokens) for r in out) == Counter((r[0], len(enc.encode_ordinary(r[1] or ""))) for r in ROWS)
    d = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in cp.STAGES:
        d = stage(spark, d, sf)
        at = f"{sf}/{name}"
        d.write.parquet(at)
        d = spark.read.parquet(at)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256)
    assert sorted(map(key, d.collect())) == sorted(map(key, cp.run(spark, sf).collect())) and d.count() > 50
