"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Attach each node's larger (or smaller) neighbours to the least node next to it; written to the shared folder.

    The least neighbours are a table of their own: the join with them then has an exchange on either side,
    and Spark can split the rows of a node with very many neighbours among tasks.
    """
    if large:
        rows = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(rows.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        out = rows.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        rows = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
        least = materialize(rows.groupBy("u").agg(F.min("v").alias("m")), "least")
        out = rows.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    out = materialize(out.distinct(), "edges")
    discard(least)
    return out


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of `edges` (u, v), component being the least node reachable; a table.

    Rounds of large and small stars, each written to the shared folder; the driver sees only a row
    count and a checksum. The number of rounds grows with the logarithm of a component's size.
    """
    now = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == tuple(mark) or mark[0] == 0:
            break
        seen = tuple(mark)
        half = _star(now, True)
        nxt = _star(half, False)
        discard(half)
        discard(now)
        now = nxt
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = materialize(now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots), "components")
    discard(now)
    return out
