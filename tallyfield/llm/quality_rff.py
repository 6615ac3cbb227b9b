"""Quality scores by random Fourier features.

Numpy takes statistics of each whole text (sizes, character classes, repetition, lines). A fixed random
map approximates a Gaussian kernel over the standardised statistics; each partition of labelled rows sums
its part of the ridge regression's normal equations, and only such sums (of a size that the number of
features sets) reach the driver. A fifth of the labelled rows is kept from the regression to calibrate
its scores by isotonic regression over score bins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, narrow, slices
from .sketch_dedup import _BYTE, _powers

FEATURES, SEED, RIDGE, BINS = 256, 7, 1e-3, 1000


def statistics(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One row of statistics for each text."""
    docs, total = len(ends) - 1, len(data)
    size = np.diff(ends).astype(float)
    at_least = np.maximum(size, 1)
    owner = np.repeat(np.arange(docs), np.diff(ends))
    hist = np.bincount(owner * 256 + data, minlength=docs * 256).reshape(docs, 256)
    share = lambda chars: hist[:, list(chars)].sum(1) / at_least
    p = hist / at_least[:, None]
    entropy = -(p * np.log(np.where(p > 0, p, 1))).sum(1)
    upper, lower = hist[:, 65:91].sum(1), hist[:, 97:123].sum(1)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(total + 1, dtype=bool)
    edge[ends] = True
    before = np.concatenate(([True], space[:-1])) | edge[:-1] if total else np.zeros(0, bool)
    after = np.concatenate((space[1:], [True])) | edge[1:] if total else np.zeros(0, bool)
    starts, stops = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    up, down = _powers(total)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[:total], dtype=np.uint64)))
    word = (sums[stops] - sums[starts]) * down[starts]
    of = np.searchsorted(ends, starts, "right") - 1
    n = np.bincount(of, minlength=docs).astype(float)
    n1 = np.maximum(n, 1)
    length = (stops - starts).astype(float)
    mean = np.bincount(of, length, docs) / n1
    var = np.bincount(of, length**2, docs) / n1 - mean**2

    def distinct(h: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct values, and the count of the most frequent one, for each text."""
        o = np.argsort(h)
        o = o[np.argsort(of[o].astype(np.uint16), kind="stable")]
        h, of = h[o], of[o]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
        first = np.flatnonzero(new)
        top = np.zeros(docs)
        np.maximum.at(top, of[first], np.diff(np.append(first, len(h))))
        return np.bincount(of[first], minlength=docs).astype(float), top

    kinds, top = distinct(word, of)
    same = np.zeros(len(word), dtype=bool)
    same[1:] = (word[1:] == word[:-1]) & (of[1:] == of[:-1])
    stutter = np.bincount(of, same, docs)
    pair = word[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[1:] if len(word) else word
    within = of[1:] == of[:-1]
    pairs, _ = distinct(pair[within], of[:-1][within]) if len(word) else (np.zeros(docs), None)
    last = data[np.maximum(stops - 1, 0)] if total else data
    ends_odd = np.bincount(of, np.isin(last, np.frombuffer(b"!#$%&*|=+~^<>@", np.uint8)), docs)
    ends_stop = np.bincount(of, np.isin(last, np.frombuffer(b".,;:?", np.uint8)), docs)
    initial = data[starts] if total else data
    capital = np.bincount(of, (initial >= 65) & (initial <= 90), docs)
    lines = hist[:, 10] + 1.0
    return np.column_stack([
        np.log1p(size), np.log1p(n), mean, np.sqrt(np.maximum(var, 0)), upper / np.maximum(upper + lower, 1), share(range(48, 58)), share(b"!"), share(b"#$%&*@^~"), share(b"|<>=+_/\\"),
        share(b".,;:?"), share(b"\n"), hist[:, 128:].sum(1) / at_least, entropy, kinds / n1, np.log1p(n1) - np.log1p(kinds), top / n1, stutter / n1, pairs / n1, ends_odd / n1, ends_stop / n1, capital / n1, np.log1p(n / lines), np.log1p(lines),
    ])


def _statistician(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, data, ends in slices(batches):
        x = statistics(data, ends)
        rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))
        yield pa.RecordBatch.from_arrays([ids, rows], names=["row", "x"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _summed(rows: DataFrame, make, width: int) -> np.ndarray:
    """The sum, over all rows' partitions, of the vectors that `make` gives for (x, y)."""

    def part(batches):
        total = np.zeros(width)
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                s = b.slice(at, 4096)
                total += make(_matrix(s.column(0)), np.asarray(s.column(1), dtype=float))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], names=["v"])

    def add(batches):
        total = np.zeros(width)
        for b in batches:
            total += _matrix(b.column(0)).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], names=["v"])

    sums = rows.select("x", "y").mapInArrow(part, "v array<double>")
    for parts in (32, 4):  # a tree: tasks take the vectors one batch after the other
        sums = sums.repartition(parts).mapInArrow(add, "v array<double>")
    return np.sum([np.zeros(width), *(r.v for r in sums.collect())], axis=0)


def isotonic(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Non-decreasing fit of y by pooling adjacent violators; score ascending."""
    blocks: list[list[float]] = []
    for v, w in zip(y, weight, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.repeat([b[0] for b in blocks], [b[2] for b in blocks])


class Model:
    def __init__(self, mean, scale, width):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.w = rng.standard_normal((width, FEATURES)) / np.sqrt(width / 2)
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)
        self.beta = self.knots = self.levels = None

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.column_stack([np.sqrt(2 / FEATURES) * np.cos(z @ self.w + self.b), z, np.ones(len(z))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.levels)


def fit(labelled: DataFrame, width: int) -> Model | None:
    """A model from rows (doc_id, x, y), y 0 or 1; None if there is none."""
    sums = _summed(labelled, lambda x, y: np.concatenate([x.sum(0), (x**2).sum(0), [len(x)]]), 2 * width + 1)
    n = sums[-1]
    if n == 0:
        return None
    mean = sums[:width] / n
    scale = np.sqrt(np.maximum(sums[width:-1] / n - mean**2, 0))
    model = Model(mean, np.where(scale > 1e-9, scale, 1), width)
    fifth = F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(5)) == 0
    k = FEATURES + width + 1

    def normal(x, y):
        z = model.features(x)
        return np.concatenate([(z.T @ z).reshape(-1), z.T @ y])

    sums = _summed(labelled.where(~fifth), normal, k * k + k)
    gram = sums[: k * k].reshape(k, k)
    model.beta = np.linalg.solve(gram + RIDGE * max(n, 1) / k * np.eye(k), sums[k * k :])

    def binned(x, y):
        i = np.clip(np.round((model.raw(x) + 0.5) / 2 * BINS), 0, BINS).astype(int)
        return np.concatenate([np.bincount(i, minlength=BINS + 1), np.bincount(i, y, BINS + 1)])

    sums = _summed(labelled.where(fifth), binned, 2 * (BINS + 1))
    count, ones = sums[: BINS + 1], sums[BINS + 1 :]
    at = np.flatnonzero(count)
    if not len(at):
        model.knots, model.levels = np.array([0.0, 1.0]), np.array([0.0, 1.0])
        return model
    # one row of each class at either end keeps the scores inside (0, 1)
    knots = np.concatenate([[-0.5], at / BINS * 2 - 0.5, [1.5]])
    y = np.concatenate([[0.0], ones[at] / count[at], [1.0]])
    model.knots, model.levels = knots, np.clip(isotonic(knots, y, np.concatenate([[1.0], count[at], [1.0]])), 0, 1)
    return model


def quality_scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted, text_hash) of every row of `df`.

    Learns from the labelled rows whose crc32(id as text) mod 4 is not 2; held_out tells that remainder.
    Null texts are empty and scored like any text; texts of any length are read whole, a few megabytes of them
    at one time. A null id is not held out and is never learnt from. Rows that repeat an id are scored each by
    their own texts, and an id's largest label counts for all of them; equal texts (ties) score the same. Null labels are no labels. Without
    labels the score is 0.5; an empty table gives no rows. Scores are rounded to ten places, since sums over
    partitions may differ in the last bits from run to run. Only the two columns of `df` are read, whatever
    the others' names. text_hash (xxhash64, null as empty) tells texts of one id apart.
    """
    width = statistics(np.zeros(0, np.uint8), np.zeros(2, np.int64)).shape[1]
    rows = narrow(df, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.select(F.struct("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")).alias("row"), "text")
    stats = materialize(rows.mapInArrow(_statistician, f"row struct<doc_id: {kind}, text_hash: bigint>, x array<double>").select("row.doc_id", "row.text_hash", "x"), "statistics")
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    known = labels.select(F.col(label_id).alias("doc_id"), F.col(label_col).cast("double").alias("y")).where("y is not null and doc_id is not null").where(rest != 2)
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    labelled = materialize(stats.join(known, "doc_id").select("doc_id", "x", "y"), "labelled")
    model = fit(labelled, width)
    discard(labelled)

    def run(batches):
        for b in batches:
            x = _matrix(b.column(2)) if b.num_rows else np.zeros((0, width))
            s = np.round(np.clip(model.score(x), 0, 1), 10) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s)], names=["doc_id", "text_hash", "score"])

    scored = materialize(stats.mapInArrow(run, f"doc_id {kind}, text_hash long, score double"), "scores")
    discard(stats)
    return scored.select("doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "text_hash")
