"""Toxicity by nearest labelled examples under TF-IDF cosine.

The examples are a bounded sample of the labelled rows (at most PER_CLASS of each class, by hash); a quarter
of them is set aside to calibrate the votes. Terms are all words of a text and all its stems (a word's first
five letters); nothing is left out. A term weighs (1 + ln tf) * idf * relevance: idf counts over all
documents, relevance is the difference of the classes' smoothed log frequencies in the sample (known as delta
TF-IDF), without which invented or rare words drown the few that matter. Terms that no example has can't
match one; they only lengthen the query, with the idf of an unseen term and the relevance 0 of one.

The examples' unit vectors, put in an order that keeps similar ones together, form an inverted index in
blocks of 64: for every block the postings of its own terms, and for every term the largest weight in each
block. A document visits a block only if the bound from these maxima reaches its k-th best cosine, so the
neighbours are exact. Votes weigh by squared cosine and by how many labelled rows an example stands for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import discard, materialize, mix64, narrow, slices
from .quality_rff import isotonic
from .sketch_dedup import _BYTE, _powers

PER_CLASS, NEAREST, BLOCK, STEM = 1000, 25, 64, 5
#: Rows of prior evidence that shrink a term's relevance towards 0.
PRIOR = 10.0


def _lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pc.utf8_lower(pc.fill_null(b.column(1).cast(pa.large_string()), ""))], names=["row", "text"])


def term_counts(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terms, counts, first): each text's distinct term hashes in order, how often, and where each text's begin (and the end).

    Words are runs of ASCII letters and of all bytes beyond ASCII; `data` holds lower-cased UTF-8.
    """
    docs, total = len(ends) - 1, len(data)
    letter = ((data >= 97) & (data <= 122)) | (data >= 128)
    edge = np.zeros(total + 1, dtype=bool)
    edge[ends] = True
    before = np.concatenate(([True], ~letter[:-1])) | edge[:-1] if total else np.zeros(0, bool)
    after = np.concatenate((~letter[1:], [True])) | edge[1:] if total else np.zeros(0, bool)
    starts, stops = np.flatnonzero(letter & before), np.flatnonzero(letter & after) + 1
    up, down = _powers(total)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[:total], dtype=np.uint64)))
    of = np.searchsorted(ends, starts, "right") - 1
    words = mix64((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64))
    chars = np.flatnonzero((data & 0xC0) != 0x80)  # where characters begin
    cut = np.searchsorted(chars, starts) + STEM
    cut = np.append(chars, total)[np.minimum(cut, len(chars))]
    long = cut <= stops
    stems = mix64((sums[cut[long]] - sums[starts[long]]) * down[starts[long]] ^ np.uint64(0xA0761D6478BD642F))
    h, owner = np.concatenate((words, stems)), np.concatenate((of, of[long]))
    o = np.argsort(h)
    o = o[np.argsort(owner[o].astype(np.uint16), kind="stable")]
    h, owner = h[o], owner[o]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    return h[first], np.diff(np.append(first, len(h))), np.searchsorted(owner[first], np.arange(docs + 1))


class BlockMaxIndex:
    """Postings of unit vectors (terms, weights) by block and term, with block maxima."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int):
        self.count, self.blocks = len(vectors), max(1, -(-len(vectors) // BLOCK))
        self.top = np.zeros((terms + 1, self.blocks), np.float32)
        self.row = np.full((self.blocks, terms + 1), -1, np.int32)  # a term's postings in a block, if any
        self.postings = []
        for b in range(self.blocks):
            own = vectors[b * BLOCK : (b + 1) * BLOCK]
            local = np.unique(np.concatenate([v[0] for v in own])) if own else np.zeros(0, np.int64)
            x = np.zeros((len(local), BLOCK), np.float32)
            for e, (t, w) in enumerate(own):
                x[np.searchsorted(local, t), e] = w
            self.postings.append(x)
            self.row[b, local] = np.arange(len(local))
            if len(local):
                self.top[local, b] = x.max(1)

    def scores(self, b: int, ids: np.ndarray, weights: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Cosines of queries (terms `ids` with `weights`, each query's from `first` on) with block b's examples."""
        row = self.row[b, ids]
        hit = np.flatnonzero(row >= 0)
        out = np.zeros((len(first) - 1, BLOCK), np.float32)
        at = np.searchsorted(hit, first)
        some = np.flatnonzero(at[1:] > at[:-1])
        if len(some):
            x = self.postings[b][row[hit]]
            x *= weights[hit, None]
            out[some] = np.add.reduceat(x, at[some], axis=0)
        return out

    def nearest(self, ids: np.ndarray, weights: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query the k examples of largest cosine (ties: smaller number first) and their cosines; -1 and 0 where fewer have one above 0."""
        q = len(first) - 1
        weights = weights.astype(np.float32)
        bound = np.zeros((q, self.blocks), np.float32)
        some = np.flatnonzero(first[1:] > first[:-1])
        if len(some):
            x = self.top[ids]
            x *= weights[:, None]
            bound[some] = np.add.reduceat(x, first[some], axis=0)
        bound += np.float32(1e-5) * (bound > 0)  # sums of small numbers round either way
        best_e, best_s = np.full((q, k), self.count, np.int64), np.zeros((q, k), np.float32)
        seen = np.zeros((q, self.blocks), dtype=bool)

        def visit(b: int, who: np.ndarray) -> None:
            n = first[who + 1] - first[who]
            start = np.concatenate(([0], np.cumsum(n)))
            take = np.arange(start[-1]) - np.repeat(start[:-1] - first[who], n)
            s = np.round(self.scores(b, ids[take], weights[take], start), 6)
            e = np.broadcast_to(np.arange(BLOCK) + b * BLOCK, s.shape)
            s, e = np.concatenate((best_s[who], s), axis=1), np.concatenate((best_e[who], e), axis=1)
            o = np.lexsort((e, -s), axis=1)[:, :k]
            best_s[who], best_e[who] = np.take_along_axis(s, o, 1), np.take_along_axis(e, o, 1)
            seen[who, b] = True

        most = bound.argmax(1)  # the most promising block of each query sets a threshold for the others
        for b in np.unique(most).tolist():
            visit(b, np.flatnonzero(most == b))
        for b in np.argsort(-bound.sum(0), kind="stable").tolist():
            who = np.flatnonzero(~seen[:, b] & (bound[:, b] > 0) & (bound[:, b] >= best_s[:, -1]))
            if len(who):
                visit(b, who)
        return np.where(best_s > 0, best_e, -1), best_s


class Voter:
    """The index with everything that turns term counts into scores."""

    def __init__(self, terms: np.ndarray, weight: np.ndarray, unseen: float, examples: list[tuple], class_weight: dict[int, float]):
        """`terms` ascending with a weight each; `examples`: (id, term hashes, counts, label, whether for calibration)."""
        self.terms, self.unseen = terms, unseen
        self.weight = np.append(weight, 0.0)  # the last: terms that no example has
        index = [e for e in examples if not e[4]]
        vectors = [self._own(e[1], e[2]) for e in index]
        order = _similar_together(vectors, len(terms))
        index, vectors = [index[i] for i in order], [vectors[i] for i in order]
        self.name = [e[0] for e in index] + [None]
        self.y = np.array([e[3] for e in index] + [0], dtype=float)
        self.mass = np.array([class_weight[e[3]] for e in index] + [0.0])
        self.vectors = [(t.astype(np.int32), w.astype(np.float32)) for t, w in vectors]
        self.index = BlockMaxIndex(self.vectors, len(terms))
        total = self.mass.sum()
        self.rate = float((self.mass * self.y).sum() / total) if total else 0.5
        self.pull = 1e-3 * min(class_weight.values()) if class_weight else 1.0
        self.knots, self.levels = np.array([0.0, 1.0]), np.array([0.0, 1.0])
        held = [e for e in examples if e[4]]
        if held and index:
            raw = np.concatenate([self._votes(e[1], e[2], np.array([0, len(e[1])]))[0] for e in held])
            y, w = np.array([e[3] for e in held], dtype=float), np.array([class_weight[e[3]] for e in held])
            if 0 < y.sum() < len(y):
                step = np.round(raw * 50).astype(int)
                n, ones = np.bincount(step, w, 51), np.bincount(step, w * y, 51)
                at = np.flatnonzero(n)
                self.knots = at / 50
                self.levels = isotonic(self.knots, ones[at] / n[at], n[at])

    def __getstate__(self) -> dict:
        """Only the vectors travel; every worker builds the index from them, once."""
        return {k: v for k, v in self.__dict__.items() if k != "index"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.index = BlockMaxIndex(self.vectors, len(self.terms))

    def _own(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, w, _ = self._weigh(terms, counts, np.array([0, len(terms)]))
        return ids, w

    def _weigh(self, terms: np.ndarray, counts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, weights, first) of the texts' unit vectors, of known terms alone; unknown ones count in the length."""
        n = len(self.terms)
        at = np.searchsorted(self.terms, terms)
        known = (at < n) & (self.terms[np.minimum(at, n - 1)] == terms) if n else np.zeros(len(terms), bool)
        w = (1 + np.log(counts)) * np.where(known, self.weight[np.where(known, at, n)], self.unseen)
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        norm = np.sqrt(np.bincount(owner, w**2, len(first) - 1))
        w = w / np.where(norm > 0, norm, 1)[owner]
        keep = known & (w > 0)
        return at[keep], w[keep], np.concatenate(([0], np.cumsum(keep)))[first]

    def _votes(self, terms: np.ndarray, counts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        e, s = self.index.nearest(*self._weigh(terms, counts, first), NEAREST)
        w = s.astype(float) ** 2 * self.mass[e]
        return ((w * self.y[e]).sum(1) + self.pull * self.rate) / (w.sum(1) + self.pull), e, s

    def score(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(scores, examples, cosines) of texts."""
        if not self.index.count:
            return np.full(len(ends) - 1, 0.5), np.full((len(ends) - 1, NEAREST), -1), np.zeros((len(ends) - 1, NEAREST))
        raw, e, s = self._votes(*term_counts(data, ends))
        return np.clip(np.interp(raw, self.knots, self.levels), 0, 1), e, s


def _similar_together(vectors: list[tuple[np.ndarray, np.ndarray]], terms: int) -> list[int]:
    """An order of the examples in which blocks hold similar ones: halves by nearness to one of two far ones, again and again."""
    if not vectors:
        return []
    plain = BlockMaxIndex(vectors, terms)
    near = np.zeros((len(vectors), plain.blocks * BLOCK), np.float32)
    for at in range(0, len(vectors), BLOCK):  # a block of queries at one time
        some = vectors[at : at + BLOCK]
        first = np.concatenate(([0], np.cumsum([len(v[0]) for v in some])))
        ids, w = np.concatenate([v[0] for v in some]), np.concatenate([v[1] for v in some]).astype(np.float32)
        near[at : at + BLOCK] = np.concatenate([plain.scores(b, ids, w, first) for b in range(plain.blocks)], axis=1)
    near = near[:, : len(vectors)]

    def order(some: np.ndarray) -> list[int]:
        if len(some) <= BLOCK:
            return some.tolist()
        a = some[near[some[0], some].argmin()]
        b = some[near[a, some].argmin()]
        some = some[np.argsort(near[some, b] - near[some, a], kind="stable")]
        half = max(1, len(some) // 2 // BLOCK) * BLOCK
        return order(some[:half]) + order(some[half:])

    return order(np.arange(len(vectors)))


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, data, ends in slices(_lower(batches)):
        terms, counts, first = term_counts(data, ends)
        at = pa.array(first.astype(np.int32))
        yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(at, pa.array(terms.view(np.int64))), pa.ListArray.from_arrays(at, pa.array(counts.astype(np.int64)))], names=["row", "terms", "times"])


def _frequencies(shared):
    """One vector for each partition: in how many of its texts each of the shared terms stands, and the number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        n = np.zeros(len(vocabulary) + 1, np.int64)
        for _, data, ends in slices(_lower(batches)):
            terms, _, _ = term_counts(data, ends)
            at = np.minimum(np.searchsorted(vocabulary, terms), len(vocabulary) - 1)
            n[:-1] += np.bincount(at[vocabulary[at] == terms], minlength=len(vocabulary))
            n[-1] += len(ends) - 1
        yield pa.RecordBatch.from_arrays([pa.array([n.tobytes()], pa.binary())], names=["n"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of the partition's vectors, if it has any."""
    total = None
    for b in batches:
        for x in b.column(0).to_pylist():
            v = np.frombuffer(x, np.int64)
            total = v.copy() if total is None else total + v
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["n"])


def toxicity_scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic", threshold: float = 0.7, per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence, similarity) of every row of `df`.

    Learns from labelled rows whose crc32(id as text) mod 3 is not 1 (held_out tells that remainder), at
    most `per_class` rows of each class; three quarters of these are the examples, the rest calibrates. That
    bounds what the driver collects and broadcasts. Whole texts count, of any length. Null texts are empty;
    a text that shares no term with an example scores what the examples' rate is calibrated to. `evidence` lists
    the nearest examples' ids by falling cosine (equal ones: in the index's order), `similarity` the cosines.
    A null id is not held out and never learnt from; labels of ids that `df` lacks count for nothing; rows that repeat an id are scored each; an id's largest
    label counts, and of its texts the least. Without labels the score is 0.5 and evidence empty. An empty table
    gives no rows. Only the named columns are read, whatever the others' names.
    """
    spark = df.sparkSession
    rows = narrow(df, id_col, text_col).select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    known = labels.select(F.col(label_id).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("y is not null and doc_id is not null").where(rest != 1)
    # labels of documents that aren't there must neither fill the sample nor weigh in the classes
    known = materialize(known.groupBy("doc_id").agg(F.max("y").alias("y")).join(rows.select("doc_id"), "doc_id", "left_semi"), "known")
    sizes = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    few = None
    for y in sorted(sizes):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        few = part if few is None else few.union(part)
    examples: list[tuple] = []
    if few is not None:
        # the sample's size is bounded by per_class, so its ids may be broadcast
        picked = rows.join(F.broadcast(few), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
        picked = picked.select(F.struct("doc_id", "y", (F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(4)) == 0).alias("held")).alias("row"), "text")
        counted = materialize(picked.mapInArrow(_counter, f"row struct<doc_id: {kind}, y: int, held: boolean>, terms array<bigint>, times array<bigint>"), "examples")
        for r in counted.orderBy("row.doc_id").collect():
            examples.append((r.row.doc_id, np.array(r.terms, np.int64).view(np.uint64), np.array(r.times, np.int64), r.row.y, r.row.held))
        discard(counted)
    discard(known)
    drawn = {y: sum(e[3] == y for e in examples) for y in {e[3] for e in examples}}
    class_weight = {y: sizes[y] / n for y, n in drawn.items()}
    index = [e for e in examples if not e[4]]
    terms = np.unique(np.concatenate([e[1] for e in index])) if index else np.zeros(0, np.uint64)
    weight, unseen = np.zeros(len(terms)), 0.0
    if len(terms):
        shared = spark.sparkContext.broadcast(terms)
        sums = rows.mapInArrow(_frequencies(shared), "n binary")
        for parts in (32, 4):  # a tree, as the number of partitions grows with the corpus
            sums = sums.repartition(parts).mapInArrow(_added, "n binary")
        n_all = sum((np.frombuffer(bytes(r.n), np.int64) for r in sums.collect()), np.zeros(len(terms) + 1, np.int64))
        df_all, texts = n_all[:-1].astype(float), int(n_all[-1])
        in_class = {y: np.zeros(len(terms)) for y in (0, 1)}
        for _, t, _, y, _ in index:
            in_class[int(y > 0)][np.searchsorted(terms, t)] += 1
        n = {y: sum(int(e[3] > 0) == y for e in index) for y in (0, 1)}
        share = {y: (n[y] + 1) / (len(index) + 2) for y in (0, 1)}
        rate = lambda y: np.log((in_class[y] + PRIOR * share[y]) / (n[y] + PRIOR * share[y]))
        weight = np.log1p(texts / np.maximum(df_all, 1)) * np.abs(rate(1) - rate(0))
    shared = spark.sparkContext.broadcast(Voter(terms, weight, unseen, examples, class_weight))

    def run(batches):
        voter = shared.value
        name = pa.array(voter.name, ids_type)
        for ids, data, ends in slices(_lower(batches), 1 << 18):
            score, e, s = voter.score(data, ends)
            some = e >= 0
            at = pa.array(np.concatenate(([0], np.cumsum(some.sum(1)))).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(score), pa.ListArray.from_arrays(at, name.take(pa.array(e[some]))), pa.ListArray.from_arrays(at, pa.array(s[some].astype(np.float64)))],
                names=["doc_id", "score", "evidence", "similarity"],
            )

    ids_type = to_arrow_type(rows.schema["doc_id"].dataType)
    scored = rows.mapInArrow(run, f"doc_id {kind}, score double, evidence array<{kind}>, similarity array<double>")
    return scored.select("doc_id", F.coalesce(rest == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence", "similarity")
