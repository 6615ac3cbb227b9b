"""Byte-level BPE encoding and decoding with given ranks.

A task takes its rows in slices of a few megabytes. Numpy finds the pretokens of a slice (runs of
letters, numbers, other signs and blanks, with their contractions and leading spaces), and each distinct
pretoken is encoded once. Merging runs over a segment tree whose leaves are byte positions: a leaf holds
the rank of the pair that starts there, the root names the leftmost pair of least rank, and a merge
updates the leaves of its live neighbours, each in a logarithmic number of steps. Pretokens of one size
class share their steps in numpy; long ones go through the same tree one at a time.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, narrow, slices
from .sketch_dedup import _BYTE, _powers

NONE = np.int64(1) << 62
SHIFT, MASK = 7, 127  # positions of the vectorised trees: up to 64 bytes, below a rank
WIDEST = 64
# Fixed value: the split pattern that the numpy rules below stand for.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE = 300_000


class Ranks:
    """The vocabulary as arrays: every pair of known parts with the rank of what it merges to."""

    def __init__(self, lines: bytes):
        self.rank = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x)}
        self.rank_of_byte = np.array([self.rank[bytes([i])] for i in range(256)], dtype=np.int64)
        pairs = {}
        for word, r in self.rank.items():
            for k in range(1, len(word)):
                a, b = self.rank.get(word[:k]), self.rank.get(word[k:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = r
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)
        top = max(self.rank.values()) + 1
        self.length = np.zeros(top, dtype=np.int64)
        self.at = np.zeros(top, dtype=np.int64)
        flat, n = [], 0
        for word, r in self.rank.items():
            self.length[r], self.at[r] = len(word), n
            flat.append(word)
            n += len(word)
        self.flat = np.frombuffer(b"".join(flat), dtype=np.uint8)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of a and b, or NONE; parts below 0 are absent."""
        k = (a << 20) | b
        i = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where((self.keys[i] == k) & (a >= 0) & (b >= 0), self.merged[i], NONE)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        n = self.length[ids]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.at[ids] - (ends - n), n) + np.arange(total)]


def merge_one(piece: bytes, ranks: Ranks) -> list[int]:
    """Ids of one pretoken of any length."""
    get, n = ranks.rank.get, len(piece)
    size = 1 << max(0, (n - 1).bit_length())
    big = len(ranks.rank) * 4 * (n + 1) + n
    tree = [big] * (2 * size)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def key(i: int) -> int:
        j = end[i]
        r = get(piece[i : end[j]]) if j < n else None
        return big if r is None else r * n + i

    for i in range(n - 1):
        tree[size + i] = key(i)
    for i in range(size - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])

    def put(i: int, v: int) -> None:
        k = size + i
        tree[k] = v
        k >>= 1
        while k:
            v = min(tree[2 * k], tree[2 * k + 1])
            if tree[k] == v:
                break
            tree[k] = v
            k >>= 1

    while tree[1] != big:
        i = tree[1] % n
        j = end[i]
        end[i] = end[j]
        if end[j] < n:
            before[end[j]] = i
        put(j, big)
        put(i, key(i))
        if before[i] >= 0:
            put(before[i], key(before[i]))
    out, i = [], 0
    while i < n:
        out.append(get(piece[i : end[i]]))
        i = end[i]
    return out


def merge_many(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all pieces in turn, count of each) for pieces of at most WIDEST bytes of one size class."""
    n, width = len(starts), 1 << max(1, (int(sizes.max()) - 1).bit_length())
    pos = np.arange(width)
    inside = pos[None, :] < sizes[:, None]
    part = np.where(inside, ranks.rank_of_byte[data[np.minimum(starts[:, None] + pos, len(data) - 1)]], -1)
    after = np.where(pos[None, :] + 1 < sizes[:, None], pos + 1, width).repeat(1, axis=0)
    after = np.concatenate((after, np.full((n, 1), width)), axis=1)  # the place `width` is the end
    before = np.tile(np.concatenate((pos - 1, [0])), (n, 1))
    part = np.concatenate((part, np.full((n, 1), -1)), axis=1)
    tree = np.full((n, 2 * width), NONE, dtype=np.int64)
    first = ranks.pair(part[:, :-2], part[:, 1:-1])
    tree[:, width : 2 * width - 1] = np.where(first == NONE, NONE, (first << SHIFT) | pos[:-1])
    k = width
    while k > 1:
        tree[:, k // 2 : k] = np.minimum(tree[:, k : 2 * k : 2], tree[:, k + 1 : 2 * k : 2])
        k //= 2
    row = np.flatnonzero(tree[:, 1] != NONE)
    while len(row):
        root = tree[row, 1]
        i = root & MASK
        j = after[row, i]
        part[row, i] = root >> SHIFT
        part[row, j] = -1
        nxt = after[row, j]
        after[row, i] = nxt
        before[row, nxt] = i
        left = before[row, i]
        has = left >= 0
        left = np.maximum(left, 0)
        new = ranks.pair(part[row, i], part[row, nxt])
        tree[row, width + i] = np.where(new == NONE, NONE, (new << SHIFT) | i)
        tree[row, width + np.minimum(j, width - 1)] = NONE
        old = ranks.pair(part[row, left], part[row, i])
        value = np.where(old == NONE, NONE, (old << SHIFT) | left)
        tree[row, width + left] = np.where(has, value, tree[row, width + left])
        for leaf in (width + i, width + j, width + left):
            leaf = leaf >> 1
            while leaf[0]:
                tree[row, leaf] = np.minimum(tree[row, 2 * leaf], tree[row, 2 * leaf + 1])
                leaf = leaf >> 1
        row = row[tree[row, 1] != NONE]
    live = part[:, :width] >= 0
    return part[:, :width][live], live.sum(1)


def char_classes() -> np.ndarray:
    """Per code point: 0 other, 1 letter, 2 number, 3 white space."""
    import regex

    out = np.zeros(0x110000, dtype=np.uint8)
    chars = "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 0x110000)))
    for kind, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, chars):
            a, b = m.span()
            skip = lambda x: x + 0x800 if x >= 0xD800 else x
            out[skip(a) : skip(b - 1) + 1] = kind
    return out


def pretokens(data: np.ndarray, ends: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """First bytes of all pretokens of the concatenated texts, in order, and the end of the data.

    The pattern's alternatives: a contraction, an optional space with letters, with numbers or with
    other signs, blanks up to the last one before more text, and blanks.
    """
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    b = data[lead].astype(np.int64)
    c = np.where(b < 0x80, b, np.where(b < 0xE0, b & 0x1F, np.where(b < 0xF0, b & 0x0F, b & 0x07)))
    for k, least in ((1, 0xC0), (2, 0xE0), (3, 0xF0)):
        more = np.flatnonzero(b >= least)
        c[more] = c[more] << 6 | (data[lead[more] + k] & 0x3F)
    kind = classes[c]
    n = len(c)
    doc = np.zeros(n + 1, dtype=bool)
    doc[np.searchsorted(lead, ends)] = True  # where a text starts, and the end
    run = doc[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(run)
    stop = np.append(run[1:], n)
    k = kind[run]
    blank, ends_text = k == 3, doc[stop]
    last = stop - 1
    spare = blank & ~ends_text  # a run of blanks before more text gives up its last one
    gives = spare & (c[np.minimum(last, n - 1)] == 32)
    joined = np.zeros(len(run), dtype=bool)
    joined[1:] = gives[:-1]  # the run starts with the space before it
    starts = [run[~blank & ~joined], run[blank & ~(gives & (stop - run == 1))], last[spare]]
    # contractions: a lone quote, with no space of its own, before certain letters of the same text
    q = np.flatnonzero((k == 0) & (c[run] == 39) & (stop - run == 1) & ~joined & ~ends_text)
    if len(q):
        x, to = c[np.minimum(stop[q], n - 1)], stop[q + 1] - stop[q]
        y = c[np.minimum(stop[q] + 1, n - 1)]
        one = np.isin(x, [ord(z) for z in "stmd"])
        two = (to >= 2) & ((np.isin(x, [ord("r"), ord("v")]) & (y == ord("e"))) | ((x == ord("l")) & (y == ord("l"))))
        took = np.where(one, 1, np.where(two, 2, 0)) * (k[q + 1] == 1)
        q, took, to = q[took > 0], took[took > 0], to[took > 0]
        starts[0] = starts[0][~np.isin(starts[0], stop[q])]
        starts.append((stop[q] + took)[took < to])
    at = np.unique(np.concatenate(starts))
    return np.append(lead[at], len(data))


class Encoder:
    """Encodes slices of texts; remembers what it has encoded, up to a bound."""

    def __init__(self, ranks: Ranks, classes: np.ndarray):
        self.ranks, self.classes = ranks, classes
        self.known: dict[int, np.ndarray] = {}

    def pieces(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        """Ids of each piece."""
        out: list = [None] * len(starts)
        raw, todo, get = data.tobytes(), {}, self.ranks.rank.get
        for i, (a, n) in enumerate(zip(starts.tolist(), sizes.tolist(), strict=True)):
            r = get(raw[a : a + n])
            if r is not None:
                out[i] = np.array([r])
            elif n > WIDEST:
                out[i] = np.array(merge_one(raw[a : a + n], self.ranks))
            else:
                todo.setdefault((n - 1).bit_length(), []).append(i)
        for rows in todo.values():
            rows = np.array(rows)
            for at in range(0, len(rows), 8192):
                x = rows[at : at + 8192]
                ids, count = merge_many(data, starts[x], sizes[x], self.ranks)
                for i, part in zip(x.tolist(), np.split(ids, np.cumsum(count)[:-1]), strict=True):
                    out[i] = part
        return out

    def encode(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, ids before each text and in all)."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(len(ends), np.int64)
        cuts = pretokens(data, ends, self.classes)
        starts, sizes = cuts[:-1], np.diff(cuts)
        up, down = _powers(len(data))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64)))
        names = mix64((sums[cuts[1:]] - sums[starts]) * down[starts] + sizes.astype(np.uint64))
        names, where, each = np.unique(names, return_index=True, return_inverse=True)
        if len(self.known) > CACHE:
            self.known.clear()
        keys = names.tolist()
        new = [i for i, h in enumerate(keys) if h not in self.known]
        if new:
            x = where[new]
            self.known.update(zip((keys[i] for i in new), self.pieces(data, starts[x], sizes[x]), strict=True))
        parts = [self.known[h] for h in keys]
        count = np.fromiter(map(len, parts), np.int64, len(parts))
        flat, first = np.concatenate(parts), np.cumsum(count) - count
        n = count[each]
        upto = np.cumsum(n)
        ids = flat[np.repeat(first[each] - (upto - n), n) + np.arange(int(upto[-1]))]
        before = np.concatenate(([0], upto))[np.searchsorted(starts, ends)]
        if not np.array_equal(self.ranks.decode(ids), data):  # two pieces under one hash: encode each by itself
            ids_of = self.pieces(data, starts, sizes)
            upto = np.cumsum(np.fromiter(map(len, ids_of), np.int64, len(ids_of)))
            ids, before = np.concatenate(ids_of), np.concatenate(([0], upto))[np.searchsorted(starts, ends)]
        return ids, before


def _runner(shared, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, classes = shared.value
        coder = Encoder(ranks, classes)
        text = np.array([b"%d" % i for i in range(len(ranks.length))], dtype=object)
        for ids, data, ends in slices(batches):
            tokens, at = coder.encode(data, ends)
            back = ranks.decode(tokens)
            words, offsets, raw = text[tokens].tolist(), at.tolist(), back.tobytes()
            stop = np.concatenate(([0], np.cumsum(ranks.length[tokens])))[at].tolist()
            sha = lambda x: hashlib.sha256(x).hexdigest()
            cols = [ids, pa.array(np.diff(at)), pa.array([sha(b",".join(words[a:b])) for a, b in zip(offsets, offsets[1:])]), pa.array([sha(raw[a:b]) for a, b in zip(stop, stop[1:])])]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols += [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(tokens.astype(np.int32))), pa.array([raw[a:b].decode() for a, b in zip(stop, stop[1:])])]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def bpe_round_trip(df: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, pattern: str = SPLIT) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256 [, ids, decoded]) of every row.

    Null texts are empty and have no token. Ids, null or repeated, pass through with their type; other
    columns of `df` are not read. The rank file is read on the driver and sent once (its size is that of
    a vocabulary, whatever the table's). Texts of any length are encoded whole. `pattern` is the vocabulary's own split
    pattern; any other than SPLIT is refused, since its pretokens would differ.
    """
    spark = df.sparkSession
    if pattern != SPLIT:
        raise ValueError(f"pretokens are found by rules that stand for one pattern only: {SPLIT}")
    with open(ranks_path, "rb") as f:
        shared = spark.sparkContext.broadcast((Ranks(f.read()), char_classes()))
    rows = narrow(df, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return rows.withColumn("text", F.col("text").cast("string")).mapInArrow(_runner(shared, with_ids), schema)
