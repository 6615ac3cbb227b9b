"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

A block is one document. Each source's target says how often its blocks are used: whole passes, and for
the rest the blocks of a seeded permutation in turn, those of at most the largest power of two that the gap still holds;
one more block follows where that ends nearer. The power halves at least with every round, so rounds are few. The exact
block quotas are then split down a binary tree of output shards; at each node the left half's counts are a
multivariate-hypergeometric draw, so every shard gets what a full shuffle would have given it while quotas stay exact.
Where there are many sources, groups of them are split first, and each group's counts at a node then say how many of its
own sources' blocks go left there, which gives the same distribution without an array of all sources. A shard's share of a
source is a range of the permutation (ranges are disjoint), and rows are shuffled within the shard. Only counts per source
and node pass through the tree; no row is moved but by its own shard number. Everything is DataFrame code.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, discard, materialize

#: Blocks of one permutation bucket: the unit in which ranks and running sums are taken.
BUCKET_BLOCKS = 2048
#: Words that an output shard holds at most, about; there are 2**LEVELS shards at least.
SHARD_WORDS, LEVELS = 2**30, 6
#: Sources, or groups of sources, that one node of the tree holds, about.
FAN = 128


def word_count(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """(source, source_size, blocks, target) from rows of (source, size).

    Sources in code-point order, null last, weigh `weights` in turn and share the sum of all sizes; a
    target stops at `cap` times its source's size and the excess goes to the others by weight. That
    settles where the sources with the least size per weight are the capped ones, which running sums
    over the per-source table (one row a source) find without a loop.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("blocks"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    by_room = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    per = per.withColumn("total", F.sum("source_size").over(whole)).withColumn("all_w", F.sum("w").over(whole))
    per = per.withColumn("rest", F.col("total") - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))).withColumn("rest_w", F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    # a source is capped if the level that holds before it would lift it above its cap
    per = per.withColumn("level", F.when(F.col("rest_w") > 0, F.col("rest") / F.col("rest_w")))
    per = per.withColumn("full", F.col("level") * F.col("w") >= cap * F.col("source_size"))
    per = per.withColumn("final", F.min(F.when(~F.col("full"), F.struct(F.col("source_size") / F.col("w"), "level"))).over(whole)["level"])
    target = F.when(F.col("full"), (cap * F.col("source_size")).cast("double")).otherwise(F.col("final") * F.col("w"))
    return per.select("source", "source_size", "blocks", target.cast("double").alias("target"))


def _unit(*cols) -> Column:
    """A uniform number in (0, 1) that the columns determine."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") + 0.5) * F.lit(2.0**-53)


def _hypergeometric(good: Column, total: Column, drawn: Column, u: Column) -> Column:
    """How many of `drawn` items, out of `total` of which `good` count, are good; `u` uniform.

    Inverts the exact distribution at every size, over a range around its mean; what lies beyond has a
    probability under 2**-53, the step of `u` (Bernstein's bound with the binomial variance, which
    bounds the hypergeometric one). Two folds over the range: the sum of all weights, then the place of `u` in it.
    """
    g, n, d = good.cast("double"), total.cast("double"), drawn.cast("double")
    low, high = F.greatest(F.lit(0.0), d + g - n), F.least(g, d)
    mean = F.when(n > 0, d * g / n).otherwise(0.0)
    reach = F.when(n > 0, 9 * F.sqrt(F.least(d, n - d) * (g / n) * (1 - g / n)) + 30).otherwise(0.0)
    a, b = F.greatest(low, F.floor(mean - reach)).cast("long"), F.least(high, F.ceil(mean + reach)).cast("long")
    bind = lambda x, f: F.transform(F.array(x), f)[0]

    def invert(p: Column) -> Column:
        # running sums of the unnormalised weights from a upwards, by the ratio of neighbouring terms
        ratio = lambda k: (p["g"] - k + 1) * (p["d"] - k + 1) / (k * (p["n"] - p["g"] - p["d"] + k))
        term = lambda s, k: F.when(k == p["a"], F.lit(1.0)).otherwise(s["term"] * ratio(k.cast("double")))
        fold = lambda below: F.aggregate(
            F.sequence(p["a"], p["b"]), F.struct(F.lit(0.0).alias("term"), F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("below")),
            lambda s, k: bind(term(s, k), lambda t: F.struct(t.alias("term"), (s["sum"] + t).alias("sum"), (s["below"] + F.when(s["sum"] + t < below, 1).otherwise(0)).cast("long").alias("below"))),
        )
        return bind(fold(F.lit(0.0))["sum"] * p["u"], lambda x: F.least(p["a"] + fold(x)["below"], p["b"]))

    return bind(F.struct(g.alias("g"), n.alias("n"), d.alias("d"), a.alias("a"), b.alias("b"), u.alias("u")), invert).cast("long")


def _split(items: DataFrame, wants: DataFrame | None, levels: int, seed: int, tag: str) -> DataFrame:
    """(shard, k, none, c): the blocks of each item in each of 2**levels shards, from (grp, k, none, c); a table.

    A node holds the counts of one group's items; its left child draws `want` of the node's blocks, item after item, each
    conditional on what is left. `wants` has (grp, node, want); without it each left child takes half of a node's blocks.
    """
    nodes = items.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("k", "none", "c"))).alias("xs")).select("grp", F.lit(1).cast("long").alias("node"), "xs")  # children of n are 2n and 2n + 1
    tables = []
    for level in range(levels):
        nodes = nodes.withColumn("total", F.aggregate("xs", F.lit(0).cast("long"), lambda s, x: s + x["c"]))
        nodes = nodes.withColumn("want", F.floor(F.col("total") / 2).cast("long")) if wants is None else nodes.join(wants, ["grp", "node"])
        # the draw is a fold over a node's items
        draw = F.aggregate(
            "xs", F.struct(F.col("total").alias("n"), F.col("want").alias("d"), F.array().cast("array<bigint>").alias("out")),
            lambda s, x: F.transform(F.array(_hypergeometric(x["c"], s["n"], s["d"], _unit(F.lit(seed), F.lit(tag), F.col("node"), x["k"], x["none"]))), lambda t: F.struct((s["n"] - x["c"]).alias("n"), (s["d"] - t).alias("d"), F.concat(s["out"], F.array(t)).alias("out")))[0],
            lambda s: s["out"],
        )
        nodes = nodes.withColumn("left", draw)
        pick = lambda right: F.zip_with("xs", "left", lambda x, t: F.struct(x["k"].alias("k"), x["none"].alias("none"), ((x["c"] - t) if right else t).alias("c")))
        nodes = nodes.select("grp", F.explode(F.array(F.struct((F.col("node") * 2).alias("node"), pick(False).alias("xs")), F.struct((F.col("node") * 2 + 1).alias("node"), pick(True).alias("xs")))).alias("x")).select("grp", "x.node", "x.xs")
        if level % 3 == 2:
            nodes = materialize(nodes.repartition("grp", "node"), "tree")
            tables.append(nodes)
    out = materialize(nodes.select((F.col("node") - 2**levels).alias("shard"), F.explode("xs").alias("x")).select("shard", "x.k", "x.none", "x.c"), "leaves")
    for t in tables:
        discard(t)
    return out


def shard_quotas(quotas: DataFrame, levels: int, seed: int = 1) -> DataFrame:
    """(shard, source, first, count): the splitting tree over 2**levels shards; a table.

    `quotas` has (source, quota). Sources fall into groups of about FAN by hash, groups into groups of groups, until
    FAN are left; these are split first. What a group has in the shards under a node's left child is then what its members
    have there together, so counts always add up, and are distributed as if all were drawn at once. No row holds more than
    one group's counts.
    """
    width = quotas.count()
    items, groups = quotas.select(F.coalesce("source", F.lit("")).alias("k"), F.col("source").isNull().alias("none"), F.col("quota").alias("c"), F.lit(0).cast("long").alias("grp")), []
    hashed = F.xxhash64("k", "none")
    while width > FAN:
        width = math.ceil(width / FAN)
        items = items.withColumn("grp", F.pmod(hashed, F.lit(width)))
        groups.append(items)
        hashed = F.floor(F.col("k").cast("long") / FAN)
        items = items.groupBy("grp").agg(F.sum("c").alias("c")).select(F.col("grp").cast("string").alias("k"), F.lit(False).alias("none"), "c", F.lit(0).cast("long").alias("grp"))
    leaves = _split(items, None, levels, seed, "split")
    for depth, members in reversed(list(enumerate(groups))):
        # a shard lies under the left child of the node 2**l + its upper l bits if the next bit is 0
        under = leaves.withColumn("l", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))).where(f"shiftright(shard, {levels} - l - 1) % 2 = 0")
        node = F.expr(f"shiftleft(1L, l) + shiftright(shard, {levels} - l)")
        wants = under.groupBy(F.col("k").cast("long").alias("grp"), node.alias("node")).agg(F.sum("c").alias("want"))
        inner = _split(members, wants, levels, seed, f"split {depth}")
        discard(leaves)
        leaves = inner
    order = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    named = leaves.select("shard", F.when(~F.col("none"), F.col("k")).alias("source"), F.col("c").alias("count"))
    out = materialize(named.withColumn("first", F.coalesce(F.sum("count").over(order), F.lit(0)).cast("long")), "quotas")
    discard(leaves)
    return out


def partial_passes(ranked: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, runs, fill): which blocks of each source make up its partial pass.

    The pass goes down the permutation in runs: (start, stop, limit) takes the blocks of at most `limit` words with
    start <= rank < stop, `limit` being the largest power of two that the gap holds, and ends before the first of them
    that overshoots. What is left then is less than that block, so the limit halves at least from run to run: a source
    has at most 64 runs, whatever its sizes and their order. All runs of a round are found
    at once, from sums per bucket and one bucket of each source. Blocks without words count in the first run
    only. Every block left over is longer than half the last gap, so at most one still fits: `fill` is the rank of the unused
    block that ends nearest the target, if it ends nearer than none does, or null. A table.
    """
    kind = "array<struct<start: bigint, stop: bigint, limit: bigint>>"
    plan = goals.select("source", F.lit(0).cast("long").alias("start"), F.col("rest").alias("gap"), F.array().cast(kind).alias("runs"), (F.col("rest") > 0).alias("open"))
    blocks = ranked.where("size > 0 and rest > 0").select("source", "bucket", "rank", "size")
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    inside = Window.partitionBy("source").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    limit = F.expr("shiftleft(1L, length(bin(gap)) - 1)")
    old = []
    for _ in range(64):
        now = plan.where("open").select(F.col("source").alias("s"), "start", "gap", limit.alias("limit"))
        fit = blocks.join(now, F.col("source").eqNullSafe(F.col("s"))).where("rank >= start and size <= limit").drop("s")
        sums = fit.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.max("gap").alias("gap")).withColumn("upto", F.sum("words").over(upto))
        over = F.col("upto") > F.col("gap")
        found = sums.groupBy("source").agg(F.sum("words").alias("all"), F.min(F.when(over, F.struct("bucket", (F.col("upto") - F.col("words")).alias("before")))).alias("x"))
        found = materialize(found.select(F.col("source").alias("s"), "all", F.col("x.bucket").alias("b"), F.col("x.before").alias("before")), "found")
        last = fit.join(found.where("b is not null"), F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
        last = last.withColumn("run", F.col("before") + F.sum("size").over(inside)).where("run > gap")
        last = last.groupBy("source").agg(F.min(F.struct("rank", (F.col("run") - F.col("size")).alias("used"))).alias("x")).select(F.col("source").alias("s2"), "x")
        plan = plan.join(found.select("s", "all"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s").join(last, F.col("source").eqNullSafe(F.col("s2")), "left").drop("s2")
        # without an overshooting block the run reaches the end; a source where nothing fits is done
        run = F.struct("start", F.coalesce("x.rank", F.lit(2**62)).alias("stop"), limit.alias("limit"))
        more = F.col("open") & (F.col("all").isNotNull() | (F.size("runs") == 0))
        left = F.col("gap") - F.coalesce("x.used", "all", F.lit(0))
        plan = plan.select(
            "source", F.when(F.col("x").isNotNull(), F.col("x.rank") + 1).otherwise(F.col("start")).alias("start"), F.when(more, left).otherwise(F.col("gap")).alias("gap"),
            F.when(more, F.array_append("runs", run)).otherwise(F.col("runs")).cast(kind).alias("runs"), (F.col("x").isNotNull() & (left > 0)).alias("open"),
        )
        plan = materialize(plan, "plan")
        for t in old:
            discard(t)
        old = [found, plan]
        if plan.where("open").isEmpty():
            break
    unused = blocks.join(plan.select(F.col("source").alias("s"), "gap", "runs"), F.col("source").eqNullSafe(F.col("s"))).where(~taken()).where("size < 2 * gap")
    best = unused.groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")), "size", "rank"))["rank"].alias("fill")).withColumnRenamed("source", "s")
    out = materialize(plan.join(best, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "runs", "fill"), "runs")
    for t in old:
        discard(t)
    return out


def taken() -> Column:
    """Whether one of a source's `runs` takes the block of the given rank and size."""
    first = (F.col("size") > 0) | (F.col("rank") < F.coalesce(F.get("runs", F.lit(0))["stop"], F.lit(0)))
    return first & F.exists("runs", lambda r: (F.col("rank") >= r["start"]) & (F.col("rank") < r["stop"]) & (F.col("size") <= r["limit"]))


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, levels: int | None = None, seed: int = 1) -> DataFrame:
    """Each row of `df` with what the mix takes of it: doc_id, text_hash, source, size, source_size, target, draws.

    `draws` lists the row's uses as (shard, position): the output shard and the place in the shard's
    local shuffle. A row is used at most `cap` times and always whole, so it adds size * size(draws)
    words; a source's words end short of the target by less than the smallest block not used in its partial pass, or beyond
    the target by less than they would be short of it without the last block. The result is read from a table of the shared folder. Null and empty texts have size 0
    and fill no gap; texts of any length are one block. A null source is a source of its own, the last one.
    The permutation is by a hash of id and text, so null ids spread; rows that repeat an id are blocks of their
    own, and rows equal in id and text (ties) may swap what they get. There are 2**`levels` shards, by default as many as the
    words ask for. Equal draws every run; an empty table gives no rows. Columns other than the three named
    are not read, whatever their names.
    """
    sizes = materialize(df.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), F.col(source_col).alias("source"), word_count(text_col).alias("size")), "sizes")
    goals = source_targets(sizes, weights, cap)
    # a target that reaches the cap means `cap` passes; rounding must not make it a hair less
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("long")
    goals = goals.withColumn("passes", passes).withColumn("rest", F.round("target").cast("long") - F.col("passes") * F.col("source_size"))
    goals = materialize(goals.withColumn("buckets", F.ceil(F.col("blocks") / BUCKET_BLOCKS)), "goals")
    placed = sizes.join(goals.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    placed = placed.withColumn("u", _unit(F.lit(seed), F.col("doc_id"), F.col("text_hash"), F.lit("block"))).withColumn("bucket", F.floor(F.col("u") * F.col("buckets")))
    inside = Window.partitionBy("source", "bucket").orderBy("u", "doc_id", "text_hash")
    starts = _before(placed, F.count("*"), "rank0")
    ranked = placed.withColumn("rn", F.row_number().over(inside)).join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).drop("s", "b")
    ranked = ranked.withColumn("rank", F.col("rank0") + F.col("rn") - 1)
    ranked = materialize(ranked.select("doc_id", "text_hash", "source", "size", "source_size", "target", "blocks", "passes", "rest", "bucket", "rank"), "ranked")

    runs = partial_passes(ranked, goals)
    picked = ranked.join(runs.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    picked = taken_rows = materialize(picked.withColumn("extra", (taken() | (F.col("rank") == F.coalesce("fill", F.lit(-1)))).cast("long")).drop("runs", "fill", "rest"), "picked")
    extras = _before(picked, F.sum("extra"), "extra0")
    quotas = picked.groupBy("source").agg(F.sum(F.col("passes") + F.col("extra")).alias("quota"))
    # the places of a partial pass follow those of the whole ones, in the order of the permutation
    inside = Window.partitionBy("source", "bucket").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    picked = picked.withColumn("nth", F.sum("extra").over(inside)).join(extras, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).drop("s", "b")
    picked = picked.withColumn("last", F.when(F.col("extra") > 0, F.col("extra0") + F.col("nth") - 1))

    if levels is None:
        words = goals.agg(F.sum("target")).first()[0] or 0
        levels = max(LEVELS, math.ceil(math.log2(max(words, 1) / SHARD_WORDS)))
    leaves = shard_quotas(quotas, levels, seed)
    ranges = leaves.where("count > 0").groupBy("source").agg(F.array_sort(F.collect_list(F.struct("first", "shard"))).alias("ranges"))
    out = picked.join(ranges.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    whole = F.when(F.col("passes") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("passes") - 1), lambda p: p * F.col("blocks") + F.col("rank"))).otherwise(F.array().cast("array<bigint>"))
    places = F.concat(whole, F.when(F.col("last").isNotNull(), F.array(F.col("passes") * F.col("blocks") + F.col("last"))).otherwise(F.array().cast("array<bigint>")))

    def shard(i: Column) -> Column:
        """Of the range that holds place i: a search by halves, one step for each level of the tree."""
        half = lambda s: F.floor((s["a"] + s["b"]) / 2).cast("int")
        step = lambda s, _: F.when(F.get("ranges", half(s))["first"] <= i, F.struct(half(s).alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), half(s).alias("b")))
        return F.aggregate(F.sequence(F.lit(0), F.lit(levels)), F.struct(F.lit(0).alias("a"), F.size("ranges").alias("b")), step, lambda s: F.get("ranges", s["a"])["shard"])

    draws = F.transform(places, lambda i: F.struct(shard(i).alias("shard"), F.xxhash64(F.lit(seed), F.lit("place"), "doc_id", "text_hash", i).alias("position")))
    out = materialize(out.select("doc_id", "text_hash", "source", "size", "source_size", "target", draws.alias("draws")), "mix")
    for t in (sizes, goals, ranked, runs, taken_rows, leaves):
        discard(t)
    return out


def _before(rows: DataFrame, what: Column, name: str) -> DataFrame:
    """(s, b, name): what comes before each bucket b of source s."""
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = rows.groupBy("source", "bucket").agg(what.alias("n"))
    return per.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias(name))


def mixed_rows(rows: DataFrame, draws: str = "draws") -> DataFrame:
    """One row per use, dealt out by shard and by sixteenth of the shard's local shuffle, in the order of that shuffle."""
    uses = rows.select("*", F.explode(draws).alias("__use")).select(*[c for c in rows.columns if c != draws], F.col("__use.shard").alias("__shard"), F.col("__use.position").alias("__position"))
    # positions are hashes: their upper bits part a shard evenly, so a shard is never one task's alone
    uses = uses.repartition("__shard", F.shiftright("__position", 60)).sortWithinPartitions("__shard", "__position")
    return uses.drop("__shard", "__position")
