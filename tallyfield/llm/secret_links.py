"""Secret scans with multipart credential linking, in DataFrame functions only.

Each kind's matches come from one split of the text by its pattern: the pieces between matches and the
matches themselves have lengths that add up to code-point offsets. Certain kinds stand alone. Weak
candidates (a short access identifier, a bare high-entropy token, an endpoint, a user field) mean little
by themselves: an interval join finds identifiers, secrets and endpoints whose scopes overlap, and a weak
candidate is reported only next to a complementary part. The join's key is the document and a block of
text, so its work grows with the number of candidates in a scope, not with a document's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: (kind, pattern, group whose length counts, least length); base kinds, in the order of listing.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),  # maximal runs: shorter ones would be dropped anyway
)
#: Weak kinds with the role each plays in a credential.
WEAK = (
    ("weak_id", r"(?<![A-Za-z0-9])[A-Z][A-Z0-9]{11,31}(?![A-Za-z0-9])", "id"),
    ("weak_user", r"(?i:user(?:name)?|login|client_?id|account)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9@._-]{3,}", "id"),
    ("weak_token", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])", "secret"),  # of ENTROPY bits a character
    ("endpoint", r"(?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|redis|mongodb|amqp)://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+", "endpoint"),
)
ROLES = {"assign": "secret", "access": "id", "hex": "secret"} | {k: r for k, _, r in WEAK}
#: Code points around a candidate that make up its scope.
SCOPE = 200
#: Shannon entropy of its characters, in bits, from which a bare token counts as random.
ENTROPY = 3.5
#: Matches whose offsets one inner fold adds up.
PIECE = 256
_SPANS = "array<struct<start:int,end:int,kind:string>>"


def _bits(word: Column) -> Column:
    """Shannon entropy of the characters of `word`."""
    share = lambda c: (F.length(word) - F.length(F.replace(word, c, F.lit("")))) / F.length(word)
    return F.aggregate(F.transform(F.array_distinct(F.split(word, "")), lambda c: -share(c) * F.log2(share(c))), F.lit(0.0), lambda s, x: s + x)


def spans_of(text: Column, pattern: str, kind: str, group: int = 0, least: int = 0) -> Column:
    """array<struct<start, end, kind>> of the leftmost non-overlapping matches, code points, end exclusive.

    Offsets are running sums, folded within pieces of PIECE matches and over the pieces' totals, so a text
    with very many matches doesn't copy its list for each of them.
    """
    p = F.lit(pattern)
    matches = F.regexp_extract_all(text, p, F.lit(0))
    fit = F.transform(F.regexp_extract_all(text, p, F.lit(group)), lambda m: F.length(m) >= least)
    if kind == "weak_token":
        fit = F.transform(matches, lambda m: _bits(m) >= ENTROPY)
    parts = F.arrays_zip(F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(matches)), F.length).alias("gap"), F.transform(matches, F.length).alias("size"), fit.alias("fit"))

    def offsets(parts: Column) -> Column:
        count = F.ceil(F.size(parts) / PIECE).cast("int")
        pieces = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.slice(parts, (i - 1) * PIECE + 1, PIECE))
        total = lambda q: F.aggregate(q, F.lit(0), lambda s, x: s + x["gap"] + x["size"])
        bases = lambda qs: F.aggregate(
            qs, F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("all")),
            lambda s, q: F.struct((s["at"] + total(q)).alias("at"), F.array_append(s["all"], s["at"]).alias("all")), lambda s: s["all"],
        )
        span = lambda at, x: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["size"]).alias("end"), F.lit(kind).alias("kind"))
        inner = lambda q, base: F.aggregate(
            q, F.struct(base.alias("at"), F.expr(f"cast(array() as {_SPANS})").alias("all")),
            lambda s, x: F.struct((s["at"] + x["gap"] + x["size"]).alias("at"), F.when(x["fit"], F.array_append(s["all"], span(s["at"], x))).otherwise(s["all"]).alias("all")), lambda s: s["all"],
        )
        return F.transform(F.array(pieces), lambda qs: F.flatten(F.zip_with(qs, bases(qs), inner)))[0]

    found = F.transform(F.array(parts), offsets)[0]
    return F.when(text.rlike(pattern), found).otherwise(F.expr(f"cast(array() as {_SPANS})"))


def _listed(spans: Column) -> Column:
    """kind:start:end, comma-joined, by start and then kind as listed."""
    order = [k for k, *_ in (*BASE, *WEAK)]
    rank = F.create_map(*[x for i, k in enumerate(order) for x in (F.lit(k), F.lit(i))])
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def linked_parts(candidates: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak candidates of (key, start, end, kind, role, weak) that lie within `scope` of a complementary part.

    An interval join on (key, block of `scope` code points): a candidate's scope reaches into the blocks
    before and after its own, so each left row meets the right rows of at most those blocks.
    """
    block = lambda c: F.floor(c / scope)
    left = candidates.where("weak").withColumn("block", F.explode(F.sequence(block(F.greatest(F.col("start") - scope, F.lit(0))), block(F.col("end") + scope))))
    right = candidates.select("key", F.col("start").alias("s2"), F.col("end").alias("e2"), F.col("role").alias("role2"), F.explode(F.sequence(block(F.col("start")), block(F.col("end")))).alias("block"))
    near = (F.col("s2") <= F.col("end") + scope) & (F.col("e2") >= F.col("start") - scope)
    met = left.join(right, ["key", "block"]).where((F.col("role") != F.col("role2")) & near)
    return met.groupBy("key", "start", "end", "kind").agg(F.sort_array(F.collect_set("role2")).alias("with"))


def free_weak(weak: DataFrame, base: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Rows of `weak` (key, start, end, ...) that no row of `base` covers; they meet by blocks of `scope` code points."""
    block = lambda c: F.floor(c / scope)
    left = weak.withColumn("block", block(F.col("start")))
    right = base.select(F.col("key").alias("k2"), F.col("start").alias("s2"), F.col("end").alias("e2"), F.explode(F.sequence(block(F.col("start")), block(F.col("end")))).alias("b2"))
    covered = (F.col("key") == F.col("k2")) & (F.col("block") == F.col("b2")) & (F.col("s2") <= F.col("start")) & (F.col("end") <= F.col("e2"))
    return left.join(right, covered, "left_anti").drop("block")


def secret_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row of `df`.

    Null texts are empty: no span, and base_sha256 that of an empty list. Texts of any length are searched
    whole. Ids, null or repeated, pass through, each row by itself; rows equal in id and text (ties) get the
    same. Certain kinds are always listed; weak ones only where linked, and not inside a certain one; spans that
    start together come in the order of kinds. Other columns are not read, whatever their names; an empty table
    gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    base = F.concat(*[spans_of(text, p, k, g, n) for k, p, g, n in BASE])
    weak = F.concat(*[spans_of(text, p, k) for k, p, _ in WEAK])
    # a key of its own for each row: texts that repeat an id must not be mixed up
    found = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("h1"), F.xxhash64(F.lit(7), "doc_id", "text").alias("h2"), base.alias("base"), weak.alias("weak"))
    found = materialize(found.withColumn("key", F.struct("h1", "h2")).drop("h1", "h2"), "spans")
    role = F.create_map(*[x for k, r in ROLES.items() for x in (F.lit(k), F.lit(r))])
    some = found.where(F.size("weak") > 0).dropDuplicates(["key"])
    spread = lambda c: some.select("key", F.explode(c).alias("c")).select("key", "c.*", F.lit(c == "weak").alias("weak")).withColumn("role", role[F.col("kind")])
    sure = spread("base")
    candidates = materialize(free_weak(spread("weak"), sure, scope).unionByName(sure), "candidates")
    linked = linked_parts(candidates, scope).groupBy("key").agg(F.collect_list(F.struct("start", "end", "kind")).alias("linked"))
    out = found.select("doc_id", "key", "base").join(linked, "key", "left")
    count = lambda k: F.size(F.filter("base", lambda b: b["kind"] == k)).cast("long")
    every = F.concat("base", F.coalesce("linked", F.expr(f"cast(array() as {_SPANS})")))
    out = out.select("doc_id", *[count(k).alias(f"n_{k}") for k, *_ in BASE], F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(every).alias("spans"))
    out = materialize(out, "secrets")
    discard(found)
    discard(candidates)
    return out
