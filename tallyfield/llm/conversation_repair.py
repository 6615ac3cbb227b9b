"""Repair of conversations' structure by a shortest path over scalar big-integer weights.

A conversation is mended by keeping, re-labelling or deleting its rows and by inserting empty turns, so that the role
initials become `(s?(ua)+)?`. The cheapest edits win, and of equally cheap ones the ASCII-least list of their initials.
Both are one integer: the high digits are the cost, and below them every letter has a digit of its own, at the place
that it has in the list; unused places at the end are zero. An edge adds its cost above and its letter at the next
place, and the plain integer minimum at every node of the graph (row, state) decides everything.

States: 0 nothing yet, 1 behind the system's turn, 2 behind a user's, 3 behind an assistant's turn; 0 and 3 may end.
Letters determine the path, so of two lists that lead through the same rows to the same state at the same cost none is
the beginning of the other (the rest would be insertions, which cost more): what comes behind never changes their order.

That is also why conversations can be cut into chunks of rows. A chunk's 4 x 4 integers (from state, to state) are made
by tasks of their own, and merged by sixteen in a tree of rounds, so that a conversation with a third of all rows is
nobody's single task. Only the digest of the repaired text is one chain by its nature: for it a conversation's rows
pass through one task in order, one at a time, without being gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
#: What an undeleted truncated row adds.
TRUNCATED = 5
#: One octal digit a letter, in ASCII order; 0 is the padding.
DIGIT = {DELETE: 1, INSERT: 2, KEEP: 3, REROLE: 4}
LETTER = "\0DIKR"
#: (state, role initial that is kept or made) -> next state.
AFTER = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
STATES, ENDS = range(4), (0, 3)
#: Rows of a chunk, and chunks that one merge takes.
CHUNK, FAN = 512, 16

Entries = dict[tuple[int, int], tuple[int, str]]
_ENTRIES = "array<struct<a:int,b:int,cost:long,audit:string>>"
_CHUNK = f"conv_id {{id}}, ord long, blank long, duplicate long, truncated long, illegal long, first string, last string, entries {_ENTRIES}"


class Paths:
    """The least integers from given states over rows: cost above `width` octal digits, letters from the left."""

    def __init__(self, width: int, starts: dict[int, int]):
        self.low = 3 * width
        self.best = {a: {a: (0, self.low)} for a in starts}  # start -> state -> (integer, bits left of the next letter)
        self.step = {k: (COST[k] << self.low) for k in COST}

    def _edge(self, node: tuple[int, int], letter: str, more: int = 0) -> tuple[int, int]:
        value, place = node
        return value + self.step[letter] + (more << self.low) + (DIGIT[letter] << (place - 3)), place - 3

    def row(self, initial: str, must_go: bool, truncated: bool) -> None:
        for a, now in self.best.items():
            then: dict[int, tuple[int, int]] = {}
            for state, node in now.items():
                edges = [(state, self._edge(node, DELETE))]
                if not must_go:
                    more = TRUNCATED if truncated else 0
                    needed = "a" if state == 2 else "u"
                    edges.append((AFTER[state, needed], self._edge(node, REROLE, more)))
                    if (state, initial) in AFTER:
                        edges.append((AFTER[state, initial], self._edge(node, KEEP, more)))
                for to, edge in edges:
                    if to not in then or edge[0] < then[to][0]:
                        then[to] = edge
            self.best[a] = self._inserted(then)

    def _inserted(self, now: dict[int, tuple[int, int]]) -> dict[int, tuple[int, int]]:
        """More than a user's and an assistant's turn in a row lead back to a state already reached for less."""
        for origins, to in (((0, 1, 3), 2), ((2,), 3)):
            edges = [self._edge(now[s], INSERT) for s in origins if s in now] + ([now[to]] if to in now else [])
            if edges:
                now[to] = min(edges)
        return now

    def deleted(self, times: int) -> None:
        """`times` deletions in a row, as one edge."""
        letters = (8**times - 1) // 7  # as many digits of 1
        edge = lambda n: (n[0] + times * self.step[DELETE] + (letters << (n[1] - 3 * times)), n[1] - 3 * times)
        self.best = {a: self._inserted({s: edge(n) for s, n in now.items()}) for a, now in self.best.items()}

    def entries(self) -> Entries:
        return {(a, b): (value >> self.low, letters(value & ((1 << self.low) - 1), self.low)) for a, now in self.best.items() for b, (value, _) in now.items()}


def letters(digits: int, bits: int) -> str:
    return f"{digits:0{max(bits // 3, 1)}o}".rstrip("0").translate({ord("0") + i: c for i, c in enumerate(LETTER)})


def _integer(cost: int, audit: str, width: int) -> int:
    octal = int(audit.translate({ord(k): str(v) for k, v in DIGIT.items()}), 8) if audit else 0
    return (cost << 3 * width) | (octal << 3 * (width - len(audit)))


def joined(left: Entries, right: Entries) -> Entries:
    """The least integers over two neighbouring chunks."""
    width = max((len(x[1]) for x in left.values()), default=0) + max((len(x[1]) for x in right.values()), default=0)
    out: dict[tuple[int, int], tuple[int, tuple[int, str]]] = {}
    for (a, m), (cost, audit) in left.items():
        for (m2, b), (cost2, audit2) in right.items():
            if m == m2:
                both = cost + cost2, audit + audit2
                value = _integer(*both, width)
                if (a, b) not in out or value < out[a, b][0]:
                    out[a, b] = value, both
    return {k: v for k, (_, v) in out.items()}


def _begin() -> Entries:
    """Before the first row: nothing, or turns inserted there."""
    return {(0, 0): (0, ""), (0, 2): (COST[INSERT], INSERT), (0, 3): (2 * COST[INSERT], 2 * INSERT)}


def best_edits(entries: Entries | None) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    whole = joined(_begin(), entries or {(s, s): (0, "") for s in STATES})
    ends = [v for (_, b), v in whole.items() if b in ENDS]
    width = max(len(x[1]) for x in ends)
    return min(ends, key=lambda x: _integer(*x, width))


def damaged(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, n): the rows after damage by crc32(conv_id:turn) % 20, n of equal ones together; nulls count as one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said(conv_col), F.lit(":"), said(turn_col)).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(said(text_col), "[.!?]", "")).otherwise(said(text_col))
    role = F.when(kind == 4, F.lit("user")).otherwise(said(role_col))
    rows = df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("n"), kind.alias("kind"))
    rows = rows.where("kind <> 0").withColumn("digest", F.sha2("text", 256))
    return rows.groupBy("conv_id", "turn", "role", "digest", "text").agg(F.sum("n").alias("n"))


def _faults(rows: DataFrame) -> DataFrame:
    """`rows` with fault: 1 blank, 2 duplicate, 3 truncated, 0 none; that of the first of n equal rows (the others are duplicates, or blank too)."""
    turn = F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn").alias("turn"))
    key = F.struct(F.col("conv_id").alias("conv_id"), F.col("role").alias("role"), F.col("digest").alias("digest"))
    told = rows.withColumns({"key": key, "at": turn})
    again = told.groupBy("key").agg(F.min("at").alias("first_at"), F.count("*").alias("times")).where("times > 1").drop("times")  # most texts are said once: they need no join
    joined_rows = told.join(again, "key", "left")
    duplicate = F.col("first_at").isNotNull() & (F.col("at") != F.col("first_at"))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    return joined_rows.withColumn("fault", F.when(blank, 1).when(duplicate, 2).when(cut, 3).otherwise(0)).drop("key", "at", "first_at")


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def _chunk_of(rows: list[tuple[str, int, int]]) -> dict:
    """Counts and path integers of neighbouring rows (initial, fault, n)."""
    total = sum(n for *_, n in rows)
    paths = Paths(total + (2 * total + 15) // 5, dict.fromkeys(STATES))  # no cheapest path costs more than 2 a row and 15: that many insertions at most
    counts = [0, 0, 0, 0]
    illegal, last = 0, None
    for initial, fault, n in rows:
        illegal += last is not None and not _legal(last, initial)
        illegal += n - 1  # a role next to itself
        counts[fault] += 1
        paths.row(initial, fault in (1, 2), fault == 3)
        if n > 1:
            counts[1 if fault == 1 else 2] += n - 1
            paths.deleted(n - 1)
        last = initial
    return {"blank": counts[1], "duplicate": counts[2], "truncated": counts[3], "illegal": illegal, "first": rows[0][0], "last": last, "entries": _listed(paths.entries())}


def _listed(entries: Entries) -> list[dict]:
    return [{"a": a, "b": b, "cost": c, "audit": s} for (a, b), (c, s) in sorted(entries.items())]


def _read(listed: list[dict]) -> Entries:
    return {(e["a"], e["b"]): (e["cost"], e["audit"]) for e in listed}


_COUNTS = ("blank", "duplicate", "truncated", "illegal")


def _merged(left: dict, right: dict) -> dict:
    out = {c: left[c] + right[c] for c in _COUNTS} | {"first": left["first"], "last": right["last"]}
    out["illegal"] += not _legal(left["last"], right["first"])
    return out | {"entries": _listed(joined(_read(left["entries"]), _read(right["entries"])))}


def _arrow(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _chunk_schema(id_type: pa.DataType) -> pa.Schema:
    entry = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
    return pa.schema([("conv_id", id_type), ("ord", pa.int64()), *[(c, pa.int64()) for c in _COUNTS], ("first", pa.string()), ("last", pa.string()), ("entries", pa.list_(entry))])


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Chunks of a sorted partition; ord has the partition (a range of the order) above and the number within the conversation below."""
    part, seq, conv, rows, out, schema = TaskContext.get().partitionId() << 32, 0, None, [], [], None
    for batch in batches:
        schema = schema or _chunk_schema(batch.schema.field("conv_id").type)
        for conv_id, *row in zip(*(c.to_pylist() for c in batch.select(["conv_id", "initial", "fault", "n"]).columns)):
            if rows and (conv_id != conv or len(rows) >= most):
                out.append({"conv_id": conv, "ord": part + seq} | _chunk_of(rows))
                rows, seq = [], seq + 1 if conv_id == conv else 0
            conv = conv_id
            rows.append(row)
            if len(out) >= 1000:
                yield _arrow(out, schema)
                out = []
    if rows:
        out.append({"conv_id": conv, "ord": part + seq} | _chunk_of(rows))
    if out:
        yield _arrow(out, schema)


def _merge(table: pa.Table) -> pa.Table:
    """One chunk of at most FAN neighbouring ones."""
    rows = sorted(table.drop_columns(["up"]).to_pylist(), key=lambda r: r["ord"])
    one = rows[0]
    for row in rows[1:]:
        one = {"conv_id": one["conv_id"], "ord": one["ord"]} | _merged(one, row)
    return pa.Table.from_pylist([one | {"ord": rows[0]["ord"] // FAN}], schema=_chunk_schema(table.schema.field("conv_id").type))


def merged_chunks(chunks: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """One chunk a conversation, by rounds that merge up to FAN neighbours, and the tables this reads; only conversations with several chunks take part."""
    schema, tables, done = chunks.schema, [], None
    seq = F.col("ord").bitwiseAND((1 << 32) - 1)
    most = chunks.agg(F.max(seq)).first()[0] or 0
    with_key = lambda d: d.withColumn("key", F.struct(F.col("conv_id").alias("k")))  # noqa: E731  a struct: null is a conversation like any other
    now = with_key(chunks.withColumn("ord", F.shiftright("ord", 32) * (most + 1) + seq))
    while True:
        several = materialize(now.groupBy("key").count().where("count > 1").drop("count"), "several")
        tables.append(several)
        single = now.join(several, "key", "left_anti")
        done = single if done is None else done.unionByName(single)
        if several.isEmpty():
            return done.drop("key"), tables
        rest = now.join(several, "key", "left_semi").drop("key").withColumn("up", F.floor(F.col("ord") / FAN))
        merged = materialize(rest.groupBy("conv_id", "up").applyInArrow(_merge, schema), "merged")
        tables.append(merged)
        now = with_key(merged)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each head: the audit, decided by the integers, is followed through the conversation's rows in order."""
    head, out, schema = None, [], None

    def ended() -> dict:
        write_inserted()
        return {k: head[k] for k in ("conv_id", "gaps", *_COUNTS)} | {"cost": head["cost"], "audit": head["audit"], "repaired_sha256": sha.hexdigest()}

    def write(role: str, text: str, state: int) -> int:
        nonlocal empty
        sha.update((("" if empty else "\n") + role + ":" + text).encode())
        empty = False
        return AFTER[state, role[:1]]

    def write_inserted() -> None:
        nonlocal at, state
        while at < len(audit) and audit[at] == INSERT:
            state = write("assistant" if state == 2 else "user", "", state)
            at += 1

    for batch in batches:
        schema = schema or pa.schema([("conv_id", batch.schema.field("conv_id").type), ("gaps", pa.int64()), *[(c, pa.int64()) for c in (*_COUNTS, "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])
        for row in batch.to_pylist():
            if row["head"]:
                if head is not None:
                    out.append(ended())
                head = row | {c: row[c] or 0 for c in (*_COUNTS, "gaps")}
                head["cost"], head["audit"] = best_edits(_read(row["entries"]) if row["entries"] else None)
                audit, at, state, empty, sha = head["audit"], 0, 0, True, hashlib.sha256()
                continue
            for _ in range(row["n"]):
                write_inserted()
                edit, at = audit[at], at + 1
                if edit == KEEP:
                    state = write(row["role"], row["text"], state)
                elif edit == REROLE:
                    state = write("assistant" if state == 2 else "user", row["text"], state)
        if len(out) >= 2000:
            yield _arrow(out, schema)
            out = []
    if head is not None:
        out.append(ended())
    if out:
        yield _arrow(out, schema)


def repaired(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation of `df`.

    Rows go by turn, nulls first; rows of one turn (ties) by role and then by their texts' digest, equal ones (repeats)
    next to each other. Null roles and texts are one space, whose initial no rule allows; a null conv_id is a conversation
    of its own. Texts of any length are read whole, empty ones are blank. A conversation of which damage leaves no row has
    zeros, an empty audit and the empty string's digest. Other columns are not read, whatever their names; an
    empty table gives no rows.
    """
    spark = df.sparkSession
    rows = materialize(_faults(damaged(df, conv_col, turn_col, role_col, text_col)), "turns")
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    kind = rows.schema["conv_id"].dataType.simpleString()
    facts = rows.select("conv_id", "turn", "role", "digest", F.substring("role", 1, 1).alias("initial"), "fault", "n")
    ranged = facts.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    chunks = materialize(ranged.mapInArrow(partial(_chunks, most=chunk), _CHUNK.format(id=kind)), "chunks")
    whole, tables = merged_chunks(chunks)
    turns = rows.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    every = df.select(F.col(conv_col).alias("conv_id")).distinct()
    key = lambda d: d.withColumn("key", F.struct(F.col("conv_id").alias("k")))
    heads = key(every).join(key(turns).drop("conv_id"), "key", "left").join(key(whole).drop("conv_id", "ord", "first", "last"), "key", "left").drop("key")
    none = lambda t: F.lit(None).cast(t)
    heads = heads.select("conv_id", F.lit(True).alias("head"), none(rows.schema["turn"].dataType).alias("turn"), none("string").alias("role"), none("string").alias("digest"), none("string").alias("text"), none("long").alias("n"), "gaps", *_COUNTS, "entries")
    lines = rows.select("conv_id", F.lit(False).alias("head"), "turn", "role", "digest", "text", "n", none("long").alias("gaps"), *[none("long").alias(c) for c in _COUNTS], none(_ENTRIES).alias("entries"))
    both = heads.unionByName(lines).repartition("conv_id").sortWithinPartitions("conv_id", F.desc("head"), *order[1:])
    out = both.mapInArrow(_stream, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
    out = materialize(out, "repaired")
    for t in (rows, chunks, *tables):
        discard(t)
    return out
