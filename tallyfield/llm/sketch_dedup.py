"""Near-duplicate groups from SetSketch registers.

Every document becomes a set of distinct word shingles. A sketch holds, per register, the least of the
exponential arrival times that the set's elements draw, on an exponentially spaced, truncated scale:
registers merge by maximum and two of them agree with a probability close to the Jaccard similarity.
Bands of registers propose candidates; one bit of each of many more registers prunes them inside the
joins, and a joint likelihood of both sketches after that; whole shingle sets decide. Within a bucket, members are first held against the bucket's leader only;
afterwards only pairs that still lie in different components are looked at, so a large group of
copies costs a number of pairs in proportion to its size and yet no link between components is lost.
Buckets in which many members are still apart, such as pages of one template, form no pairs at all: rare
shingles that two whole sets must share if they are similar enough propose their pairs, exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, discard, materialize, mix64, slices
from .graph import components

ALL_REGISTERS = 2048  # the low bit of each makes up the signature
REGISTERS, ROWS = 128, 4  # the first ones in full: 32 bands of four 16-bit registers, each one exact 64-bit value
BANDS, WORDS = REGISTERS // ROWS, ALL_REGISTERS // 64
ORDERS = 4  # orders by which buckets elect their leaders
#: Members outside a bucket's largest part that may meet all its members; where there are more, rare shingles propose the pairs.
FEW = 64
#: Standard deviations that the pruning steps allow a pair of just enough similarity.
SLACK = 4.5
BASE, RATE = 1.001, np.exp(8.0)  # spacing of the register scale, and its origin
_P, _Q = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F
_cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of an odd multiplier and of its inverse, modulo 2**64."""
    size = 1 << max(10, int(n).bit_length())
    if size not in _cache:
        if size > 4 * CHUNK_BYTES:  # one very long text: not kept
            _cache.pop(max(_cache, default=0), None)
        inverse = pow(_P, -1, 1 << 64)
        both = []
        for p in (_P, inverse):
            x = np.full(size + 1, p, dtype=np.uint64)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        _cache[size] = (both[0], both[1])
    return _cache[size]


def shingle_sets(data: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each document, and each document's first index (and the end)."""
    docs = len(ends) - 1
    b = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.zeros(len(b) + 1, dtype=bool)
    edge[ends] = True
    before = np.concatenate(([True], space[:-1])) | edge[:-1] if len(b) else np.zeros(0, bool)
    after = np.concatenate((space[1:], [True])) | edge[1:] if len(b) else np.zeros(0, bool)
    starts, stops = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    up, down = _powers(len(b))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[b] * up[: len(b)], dtype=np.uint64)))
    words = mix64((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64))
    first = np.searchsorted(starts, ends)  # of each document's words
    n = np.diff(first)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    owner = np.repeat(np.arange(docs), count)
    base = np.concatenate(([0], np.cumsum(count)))
    at = np.arange(base[-1]) - base[owner] + first[owner]
    long = n[owner] >= width
    q = np.uint64(_Q)
    h = np.zeros(len(at), dtype=np.uint64)
    length = np.where(long, width, n[owner])
    for j in range(width):
        take = j < length
        i = np.minimum(at + j, max(len(words) - 1, 0))
        h = np.where(take, h * q + words[i], h) if not take.all() else h * q + words[i]
    h = mix64(h + length.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    o = np.argsort(h)
    o = o[np.argsort(owner[o].astype(np.uint16), kind="stable")]
    h, owner = h[o], owner[o]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(docs + 1))


def set_sketch(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One row of ALL_REGISTERS 16-bit registers for each set.

    An element's arrivals form a Poisson process whose marks choose the registers, so each register
    sees independent exponential times; an element stops once it is later than all registers.
    """
    docs, m = len(first) - 1, ALL_REGISTERS
    least = np.full(docs * m, np.inf)
    owner = np.repeat(np.arange(docs), np.diff(first))
    x, t, j = h, np.zeros(len(h)), 0
    last = np.full(docs, np.inf)
    while len(x):
        some = int(np.clip((1 << 16) // len(x), 1, 256))  # arrivals of each element at one time
        steps = np.arange(j + 1, j + some + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        j += some
        u = mix64(x[:, None] + steps)
        times = t[:, None] + np.cumsum(-np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / m, axis=1)
        np.minimum.at(least, ((owner * m)[:, None] + (u & np.uint64(m - 1)).astype(np.int64)).reshape(-1), times.reshape(-1))
        live = np.unique(owner) if j > 8 else np.arange(docs)
        last[live] = least.reshape(docs, m)[live].max(axis=1)
        t = times[:, -1]
        go = t < last[owner]
        x, t, owner = x[go], t[go], owner[go]
    with np.errstate(divide="ignore"):
        k = np.floor(1 + (np.log(RATE) - np.log(least)) / np.log(BASE))
    return np.clip(np.where(np.isfinite(k), k, 0), 0, 65535).astype(np.uint16).reshape(docs, m)


def _fingerprints(h: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit sums over each set's elements: with the size, what tells sets apart."""
    sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(h ^ np.uint64(s)), dtype=np.uint64))) for s in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179)]
    return [(s[first[1:]] - s[first[:-1]]).view(np.int64) for s in sums]


def _sketcher(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data, ends in slices(batches):
            h, first = shingle_sets(data, ends, width)
            n = np.diff(first)
            marks = _fingerprints(h, first)
            bands, bits = [], []
            for at in range(0, len(n), 512):
                part = first[at : at + 513]
                k = set_sketch(h[part[0] : part[-1]], part - part[0])
                bands.append(np.ascontiguousarray(k[:, :REGISTERS]).view(np.int64).reshape(-1))
                bits.append(np.packbits((k & 1).astype(bool), axis=1).view(np.int64).reshape(-1))
            rows = lambda x, w: pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * w), pa.array(np.concatenate(x)))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(marks[0]), pa.array(marks[1]), rows(bands, BANDS), rows(bits, WORDS)], names=["row", "n_shingles", "f1", "f2", "sketch", "bits"])

    return run


def _setter(width: int):
    """Shingle sets of the rows (struct<node, f1, f2>, text) whose fingerprints are as said."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data, ends in slices(batches):
            h, first = shingle_sets(data, ends, width)
            node, f1, f2 = ids.flatten()
            g1, g2 = _fingerprints(h, first)
            sets = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([node, sets], names=["node", "shingles"]).filter(pa.array((np.asarray(f1) == g1) & (np.asarray(f2) == g2)))

    return run


def joint_jaccard(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, grid: int = 161) -> np.ndarray:
    """Most likely Jaccard similarity given how many registers are larger, smaller and equal, and both set sizes."""
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = a.shape[1] - more - less
    u = (na / (na + nb))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, grid)[None, :] * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    pm, pl = np.clip(p(u - v * j), 1e-12, 1), np.clip(p(v - u * j), 1e-12, 1)
    like = more * np.log(pm) + less * np.log(pl) + same * np.log(np.clip(1 - pm - pl, 1e-12, 1))
    return np.take_along_axis(j, like.argmax(1)[:, None], 1)[:, 0]


def _pruner(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                x = batch.slice(at, 4096)
                a, b = (np.asarray(x.column(k).flatten()).view(np.uint16).reshape(x.num_rows, REGISTERS) for k in (4, 5))
                est = joint_jaccard(a, b, np.asarray(x.column(2), dtype=float), np.asarray(x.column(3), dtype=float))
                yield pa.RecordBatch.from_arrays(x.columns[:4], names=["a", "b", "na", "nb"]).filter(pa.array(est >= least))

    return run


def _bits_apart(a: str, b: str) -> Column:
    """The number of bits in which signatures a and b differ."""
    return reduce(lambda x, y: x + y, [F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(WORDS)])


def _bits_agree(a: str, b: str, percent: int) -> Column:
    """Whether signatures a and b differ in no more bits than a pair of that similarity may."""
    p = (1 - percent / 100) / 2
    return _bits_apart(a, b) <= int(ALL_REGISTERS * p + SLACK * (ALL_REGISTERS * p * (1 - p)) ** 0.5)


def _first_shared(a: str, b: str) -> Column:
    """Whether `band` is the first band in which sketches a and b agree: a pair then comes from one bucket only."""
    return ~reduce(lambda x, y: x | y, [(F.col("band") > i) & (F.col(a)[i] == F.col(b)[i]) for i in range(BANDS - 1)])


def _whole_sets(nodes: DataFrame, reps: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(node, shingles): the whole shingle sets of `nodes`, from the texts that stand for them; a table."""
    wanted = reps.select("node", "doc_id", "t", "f1", "f2").join(nodes, "node")
    rows = texts.select("row.doc_id", "row.t", "text").join(wanted, ["doc_id", "t"]).select(F.struct("node", "f1", "f2").alias("row"), "text")
    return materialize(rows.mapInArrow(_setter(width), "node long, shingles array<long>").dropDuplicates(["node"]), "sets")


def _verified(pairs: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of candidate pairs (a, b) of nodes, those whose whole sets reach the similarity; as (u, v)."""
    t = percent / 100
    margin = SLACK * (t * (1 - t) / REGISTERS) ** 0.5
    side = lambda s: reps.select(F.col("node").alias(s), F.col("n_shingles").alias(f"n{s}"), F.col("sketch").alias(f"s{s}"))
    fair = F.expr(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    near = pairs.join(side("a"), "a").join(side("b"), "b").where(fair).select("a", "b", "na", "nb", "sa", "sb")
    near = materialize(near.mapInArrow(_pruner(t - margin), "a long, b long, na long, nb long"), "near")
    of = lambda s: sets.select(F.col("node").alias(s), F.col("shingles").alias(f"x{s}"))
    both = F.size(F.array_intersect("xa", "xb"))
    linked = near.join(of("a"), "a").join(of("b"), "b").withColumn("both", both).where(f"100L * both >= {percent}L * (na + nb - both)")
    out = materialize(linked.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "links")
    discard(near)
    return out


def _rare_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(x, y, py): pairs of `members` (node, part) of different parts that share a rare enough shingle; a table.

    Shingles are ordered by the number of members that have them. Of a pair of sizes nx <= ny that reaches the
    similarity, at least 2p / (100 + p) of x's shingles and p / 100 of y's are shared, so the first shared one is among
    the first nx and ny less those numbers, plus one; and as many as the pair needs must follow in both sets. No pair
    is lost, and what all pages of a template share is too frequent to be looked up. Shingles that one member has
    take places in that order but are never looked up, nor are those that one part has to itself. `y` is the member of
    the part that has a shingle most often, if one of the two is.
    """
    held = sets.join(members, "node").select("node", "part", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    often = held.groupBy("s").agg(F.count("*").alias("often")).where("often > 1")
    ordered = held.join(often, "s").groupBy("node", "part", "n").agg(F.sort_array(F.collect_list(F.struct("often", "s"))).alias("shared"))
    ordered = ordered.withColumn("k", F.size("shared")).withColumn("looked", F.expr(f"k - ({percent}L * n + 99) div 100 + 1")).where("looked > 0")
    first = ordered.select("node", "part", "n", "k", F.posexplode(F.expr("slice(shared, 1, int(looked))")).alias("at", "x"))
    first = first.select("node", "part", "n", F.col("x.s").alias("s"), F.expr("k - at").alias("after"), F.expr(f"at <= k - (2L * {percent} * n + {99 + percent}) div {100 + percent}").alias("indexed"))
    first = materialize(first, "prefixes")
    spread = first.groupBy("s", "part").count().groupBy("s").agg(F.count("*").alias("parts"), F.max(F.struct("count", "part")).alias("top")).where("parts > 1").select("s", F.col("top.part").alias("top"))
    rows = materialize(first.join(spread, "s"), "rare")
    side = lambda d, k: d.select("s", F.col("node").alias(k), *[F.col(c).alias(c + k) for c in ("part", "n", "after")])
    fair = F.expr(f"partx <> party and (nx < ny or nx = ny and x < y) and 100L * nx >= {percent}L * ny and {100 + percent}L * least(afterx, aftery) >= {percent}L * (nx + ny)")
    minor = side(rows.where("indexed and part <> top"), "x").join(side(rows, "y"), "s").where(fair).select("x", "y", F.col("party").alias("py"))
    major = side(rows.where("indexed and part = top"), "x").join(side(rows.where("part <> top"), "y"), "s").where(fair).select(F.col("y").alias("x"), F.col("x").alias("y"), F.col("partx").alias("py"))
    out = materialize(minor.union(major).distinct(), "rare-pairs")
    discard(first)
    discard(rows)
    return out


def _joined(part: DataFrame, links: DataFrame) -> DataFrame:
    """`part` (node, component) after `links` (u, v) as well: only links between its components are contracted; a table."""
    at = lambda k: part.select(F.col("node").alias(k), F.col("component").alias(f"c{k}"))
    between = links.join(at("u"), "u", "left").join(at("v"), "v", "left").select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v")).where("u <> v")
    found = components(between)
    moved = part.join(found.select(F.col("node").alias("component"), F.col("component").alias("head")), "component", "left").select("node", F.coalesce("head", "component").alias("component"))
    out = materialize(moved.union(found.join(part, "node", "left_anti").select("node", "component")), "joined")
    discard(found)
    return out


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, set_id) of every row.

    Links documents whose shingle sets have 100 * intersection >= percent * union; a component is what
    such links connect, named by its smallest id. Null, empty and blank texts have no shingle, n_shingles 0,
    and are their own component. A row without an id takes part in nothing: component_id null, kept true.
    Rows that repeat an id are linked by their own texts, each by itself, and all of them are kept if the id
    is their component's smallest. Ids may be of any type that can be ordered. Texts of any length are
    taken whole, a few megabytes of them at a time. Equal sets (ties) collapse to one node before any pair
    is formed, so copies never meet each other in a join. Other columns of `df` are ignored, whatever their
    names. An empty table gives no rows.

    A pair at exactly 75 % stays unproposed with a probability of (1 - 0.75**4)**32, about 5e-6, and is
    pruned with one of about 4e-6 at each of two steps; above 80 % all three are below 1e-7.
    """
    kind = df.schema[id_col].dataType.simpleString()
    texts = df.select(F.struct(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("t")).alias("row"), F.col(text_col).alias("text"))
    sketched = texts.mapInArrow(_sketcher(width), f"row struct<doc_id: {kind}, t: bigint>, n_shingles long, f1 long, f2 long, sketch array<long>, bits array<long>")
    base = materialize(sketched.select("row.doc_id", "row.t", "n_shingles", "f1", "f2", "sketch", "bits"), "sketches")
    known = base.where("n_shingles > 0 and doc_id is not null")
    reps = known.groupBy("f1", "f2", "n_shingles").agg(F.min_by(F.struct("doc_id", "t", "sketch", "bits"), "doc_id").alias("x")).select("f1", "f2", "n_shingles", "x.*")
    reps = materialize(reps.withColumn("node", F.monotonically_increasing_id()), "reps")  # a node stands for a set
    bands = reps.select("node", F.posexplode("sketch").alias("band", "key"))
    # few orders for all bands: the members of a large group of near copies then meet few leaders each
    order = F.xxhash64(F.col("band") % ORDERS, "node").alias("h")
    leaders = bands.groupBy("band", "key").agg(F.min(F.struct(order, F.col("node").alias("leader"))).alias("x"), F.count("*").alias("n")).where("n > 1").select("band", "key", "x.leader")
    shared = materialize(bands.join(leaders, ["band", "key"]).select("band", "key", "node", "leader"), "buckets")
    sets = _whole_sets(shared.select("node").distinct(), reps, texts, width)  # of all that share a bucket with another
    star = shared.where("node <> leader").select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).distinct()
    signed = lambda k, b: reps.select(F.col("node").alias(k), F.col("bits").alias(b))
    star = star.join(signed("b", "xb"), "b").join(signed("a", "xa"), "a").where(_bits_agree("xa", "xb", percent)).select("a", "b")
    first = _verified(star, reps, sets, percent)
    part = components(first)
    # pairs of one bucket that are still apart: all but the bucket's largest part against everything else in it
    placed = shared.join(part, "node", "left").select("band", "key", "node", "leader", F.coalesce("component", "node").alias("part"))
    sizes = placed.groupBy("band", "key", "part").count()
    mixed = sizes.groupBy("band", "key").agg(F.count("*").alias("parts"), F.sum("count").alias("n"), F.max(F.struct("count", "part")).alias("top")).where("parts > 1")
    mixed = mixed.select("band", "key", F.col("top.part").alias("top"), (F.col("n") - F.col("top.count") > FEW).alias("many"))
    spots = materialize(placed.join(mixed, ["band", "key"]), "mixed")
    rare = _rare_pairs(spots.where("many").select("node", "part").distinct(), sets, percent)
    placed = materialize(spots.where("not many").join(reps.select("node", "bits", "sketch"), "node"), "few")
    few = placed.where("part <> top").select("band", "key", F.col("node").alias("x"), F.col("part").alias("px"), F.col("leader").alias("lead"), F.col("bits").alias("bx"), F.col("sketch").alias("sx"))
    rest = placed.select("band", "key", F.col("node").alias("y"), F.col("part").alias("py"), "top", F.col("bits").alias("by"), F.col("sketch").alias("sy"))
    # the leader's pairs have been decided; of two minor parts only one order is needed; if a pair's first shared bucket
    # is one of many parts, the pair is among those of rare shingles
    apart = few.join(rest, ["band", "key"]).where("px <> py and (py = top or x < y) and x <> lead and y <> lead").where(_bits_agree("bx", "by", percent) & _first_shared("sx", "sy"))
    apart = apart.select("x", "y", "py", _bits_apart("bx", "by").alias("bits"))
    rare_apart = rare.join(signed("x", "bx"), "x").join(signed("y", "by"), "y").where(_bits_agree("bx", "by", percent))
    apart = materialize(apart.union(rare_apart.select("x", "y", "py", _bits_apart("bx", "by").alias("bits"))), "apart")
    # the most similar pair of a document and a part joins the two if any pair does; what is apart even then is all verified
    best = apart.groupBy("x", "py").agg(F.min_by("y", F.struct("bits", "y")).alias("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    second = _verified(best, reps, sets, percent)
    joined = _joined(part, second)
    at = lambda k: joined.select(F.col("node").alias(k), F.col("component").alias(f"c{k}"))
    left = apart.join(at("x"), "x", "left").join(at("y"), "y", "left").where("coalesce(cx, x) <> coalesce(cy, y)")
    left = left.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    third = _verified(left, reps, sets, percent)
    whole = _joined(joined, third)
    ids = whole.join(reps.select("node", "doc_id"), "node").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = reps.select("f1", "f2", "n_shingles", "node", F.col("doc_id").alias("set_id")).join(whole.join(ids, "component").select("node", "component_id"), "node", "left").drop("node")
    # empty texts and rows without an id stay out of the join: they are their own
    known = known.select("doc_id", "n_shingles", "f1", "f2").join(named, ["f1", "f2", "n_shingles"]).select("doc_id", "n_shingles", F.coalesce("component_id", "set_id").alias("component_id"), "set_id")
    alone = base.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("doc_id").alias("set_id"))
    out = materialize(known.union(alone), "near-duplicates")
    for x in (base, reps, shared, sets, first, part, spots, rare, placed, apart, second, joined, third, whole):
        discard(x)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
