"""Conversation repair, centroid clusters and Merkle fingerprints against plain Python, on tables with every odd case."""

import hashlib
import random
import re
import sys
import zlib
from functools import lru_cache

import pytest

from tallyfield.llm import centroids, conversation_repair, merkle, toxic_knn

CONV = "conv_id long, turn long, role string, text string, cost int, head string, n int"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def mended(rows):
    """What the repair of one conversation's rows gives, by a recursion over pairs (cost, audit)."""
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], sha(r[2])))
    seen, faults = set(), []
    for _, role, text in out:
        body = text.strip(" \t\n\v\f\r")
        faults.append(1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0)
        seen.add((role, text))
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}

    @lru_cache(None)
    def best(i, state, inserted):
        options = []
        if i == len(out) and state in (0, 3):
            options.append((0, "", ()))
        made = "a" if state == 2 else "u"
        if inserted < 2:
            options.append(put(5, "I", best(i, step[state, made], inserted + 1), ({"a": "assistant", "u": "user"}[made] + ":",)))
        if i < len(out):
            _, role, text = out[i]
            options.append(put(2, "D", best(i + 1, state, 0), ()))
            if faults[i] in (0, 3):
                more = 5 if faults[i] == 3 else 0
                options.append(put(1 + more, "R", best(i + 1, step[state, made], 0), ({"a": "assistant", "u": "user"}[made] + ":" + text,)))
                if (state, role[:1]) in step:
                    options.append(put(more, "K", best(i + 1, step[state, role[:1]], 0), (role + ":" + text,)))
        options = [o for o in options if o]
        return min(options) if options else None

    def put(cost, letter, rest, said):
        return rest and (rest[0] + cost, letter + rest[1], said + rest[2])

    turns = [t for t, *_ in out if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(out, out[1:])]
    cost, audit, said = best(0, 0, 0)
    return (gaps, faults.count(1), faults.count(2), faults.count(3), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha("\n".join(said)))


def conversations():
    rng = random.Random(3)
    texts = ["fine.", "cut", " \t", "", "so!  ", "é ½?", None, "again.", "again.", "long " * 400 + "."]
    roles = ["user", "assistant", "system", "tool", "", None, "usher", "System"]
    rows = []
    for conv in (*range(40), None, -7):
        plain = rng.random() < 0.5
        for turn in range(rng.randint(0, 9)):
            role = ["user", "assistant"][turn % 2] if plain else rng.choice(roles)
            rows.append((conv, None if rng.random() < 0.1 else turn * rng.choice([1, 1, 3]), role, rng.choice(texts) if rng.random() < 0.5 else f"text {rng.random()}."))
            if rng.random() < 0.2:
                rows.append(rows[-1])
    # a conversation that holds most of the rows, and one whose rows are all alike
    rows += [(1000, t, rng.choice(roles[:3]), f"said {t % 150}" + rng.choice(["", ".", "."])) for t in range(900)]
    rows += [(1001, 5, "user", "the same.")] * 300
    gone = next(c for c in range(2000, 9999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return [*rows, (gone, 0, "user", "dropped.")], gone


def test_repair_equals_plain_recursion(spark):
    sys.setrecursionlimit(20_000)
    rows, gone = conversations()
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], CONV).repartition(5)
    for chunk in (512, 7):  # conversations cut into many chunks, merged in several rounds
        got = conversation_repair.repaired(df, chunk=chunk)
        assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        got = {r[0]: tuple(r)[1:] for r in got.collect()}
        assert set(got) == {r[0] for r in rows}
        for conv in got:
            assert got[conv] == mended([r for r in rows if r[0] == conv]), conv
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", sha(""))


def test_repair_of_nothing(spark):
    assert conversation_repair.repaired(spark.createDataFrame([], CONV)).count() == 0


def test_integers_order_as_pairs():
    rng = random.Random(1)
    pairs = [(rng.randint(0, 3), "".join(rng.choice("DIKR") for _ in range(rng.randint(0, 6)))) for _ in range(300)]
    assert sorted(pairs) == sorted(pairs, key=lambda p: conversation_repair._integer(*p, 8))
    assert all(conversation_repair.letters(conversation_repair._integer(0, a, 8), 24) == a for _, a in pairs)


def clusters(rows, k=8, rounds=10):
    import math

    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    cents = [v for _, v in sorted(kept, key=lambda r: (sha(f"3:{'' if r[0] is None else r[0]}"), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(cents))
    for _ in range(rounds):
        of = {}
        for _, v in kept:
            of.setdefault(near(v)[1], []).append(v)
        cents = [[sum(x) // len(of[i]) for x in zip(*of[i])] if i in of else c for i, c in enumerate(cents)]
    found = [(i, *reversed(near(v))) for i, v in kept]
    total = {c: sum(d for _, c2, d in found if c2 == c) for _, c, _ in found}
    return sorted(((i, c, d, total[c], sum(total.values()), sha(",".join(map(str, cents[c])))) for i, c, d in found), key=repr)


def test_clusters_equal_plain_rounds(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    vectors = [[float(np.float32(x)) for x in rng.normal(c % 5, 1, 64)] for c in range(300)]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(i, vectors[3]) for i in range(400, 600)]  # a third of them equal
    rows += [(None, vectors[1]), (7, vectors[2]), (700, None), (701, vectors[0][:63]), (702, [*vectors[0][:63], None]), (703, [*vectors[0][:63], float("nan")]), (704, [*vectors[0][:63], float("inf")]), (705, [])]
    df = spark.createDataFrame([(*r, 3, "v") for r in rows], "vec_id long, embedding array<float>, cluster int, v string").repartition(4)
    got = centroids.cluster_vectors(df)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == clusters(rows)
    few = [(i, v) for i, v in rows[:3]]
    assert sorted((tuple(r) for r in centroids.cluster_vectors(df.where("vec_id < 3")).collect()), key=repr) == clusters(few)
    assert centroids.cluster_vectors(df.where("false")).count() == 0
    with pytest.raises(Exception, match="component is over"):
        centroids.cluster_vectors(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>")).count()


def pieces(p):
    return [sha(x) for x in re.findall(r"(?s)[^.!?]{0,64}[.!?]+\x20*|[^.!?]{1,64}(?:\x20|\Z)|[^.!?]{64}", p)]


def tree_of(text):
    t = [[pieces(p) for p in s.split("\n")] for s in text.split("\n\n")]
    root = sha(",".join(sha(",".join(sha(",".join(p)) for p in s)) for s in t))
    return root + ":" + "|".join(";".join(",".join(d[:8] for d in p) for p in s) for s in t)


def likeness(a, b):
    if a[:64] == b[:64]:
        return 1.0
    x, y = (set(re.split("[,;|]", f[65:])) for f in (a, b))
    return 2 * len(x & y) / (len(x) + len(y))


def test_fingerprints_equal_plain_trees(spark):
    rng = random.Random(9)
    words = ["one", "two.", "drei", "½", "漢字!", "\U0001f600", "a;b|c", "x" * 70, "\n", "\n\n", "\r", "\x85", "12:3,4"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "x"), (103, rows[5][1]), (104, "long words " * 20_000), (105, "y" * 100_000), (106, "\n" * 50), (None, "no id")]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "doc_id long, text string, fingerprint string, __x int").repartition(6)
    got = {r.doc_id: r for r in merkle.document_fingerprints(df).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    assert len(got) == len(rows)
    for k, (i, text) in enumerate(order):
        text, nxt = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + nxt[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(text), sha(edited), tree_of(text), tree_of(edited)), i
        assert r.near_edited == pytest.approx(likeness(tree_of(text), tree_of(edited))) and r.near_next == pytest.approx(likeness(tree_of(text), tree_of(nxt)))
        assert (r.first_edit is None) == (text == edited) == (r.last_edit is None)
    assert got[5].fingerprint == got[103].fingerprint and got[100].fingerprint == got[101].fingerprint


def test_edits_are_located(spark):
    old, new = "a.\nb. c. d.\n\ne.\nf.", "a.\nb. X. d.\n\ne.\nf."
    got = spark.createDataFrame([(old, new), (old, old + " g."), (old, old), (old, old + "\nmore.")], "o string, n string")
    got = got.select(merkle.fingerprint(got.o).alias("o"), merkle.fingerprint(got.n).alias("n"))
    rows = got.select(merkle.first_edit(got.o, got.n), merkle.first_edit(got.o, got.n, True)).collect()
    assert [tuple(r) for r in rows] == [("0.1.1", "1.0.1"), ("1.1.0", "0.0.0"), (None, None), ("1.2", "0.0.0")]


def test_fingerprints_of_repeats_and_nothing(spark):
    df = spark.createDataFrame([(1, "same. text."), (1, "same. text."), (1, "other"), (None, None), (None, "z")], "doc_id long, text string")
    rows = merkle.document_fingerprints(df).collect()
    assert len(rows) == 5 and len({r.fingerprint for r in rows}) == 4
    assert merkle.document_fingerprints(df.where("false")).count() == 0
    one = merkle.document_fingerprints(df.where("text = 'other'")).first()
    assert one.edited_sha256 == sha("otherot"[:3] + "ot") and one.near_next == 1.0


def test_labels_without_documents_and_ids_of_other_types(spark):
    """Thousands of labels of absent documents change no score, and dates serve as ids."""
    rows = [(i, f"plain words about {'garden trees' if i % 3 else 'rivers and'} w{i}" if i % 2 else f"vile rotten insult number {i % 7} w{i}", 1 - i % 2) for i in range(120)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    orphans = spark.range(1000, 60_000).selectExpr("id as doc_id", "cast(id % 5 = 0 as int) as toxic")
    want = {r.doc_id: r.score for r in toxic_knn.toxicity_scores(docs, labels).collect()}
    got = {r.doc_id: r.score for r in toxic_knn.toxicity_scores(docs, labels.union(orphans)).collect()}
    assert got == want and min(s for i, s in got.items() if i % 2 == 0) > 0.5 > max(s for i, s in got.items() if i % 2)
    dated = lambda df: df.selectExpr("date_add(date'2020-01-01', cast(doc_id as int)) as doc_id", df.columns[1])
    by_date = toxic_knn.toxicity_scores(dated(docs), dated(labels))
    assert by_date.count() == 120 and by_date.selectExpr("max(score) > 0.5 and min(score) < 0.5").first()[0]
