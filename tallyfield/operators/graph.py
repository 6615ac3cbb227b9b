"""Connected groups of an edge table, in rounds whose number grows with the logarithm of a group's size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lake import drop_stored, stored


def _rehung(links: DataFrame, upwards: bool) -> DataFrame:
    """Every node's larger (upwards) or smaller neighbours hang from the least node next to it.

    The least neighbour is a table of its own, so the neighbours of a hub are joined with it, never gathered.
    """
    ends = links.union(links.select("v", "u")) if upwards else links
    least = ends.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = ends.where("v > u") if upwards else ends
    out = moved.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out if upwards else out.union(least.select("u", F.col("m").alias("v")))


def groups(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, head) of every node in `edges` (u, v): head is the least node it is connected with.

    Nodes may be of any ordered type, structs included. Links of a node to itself, or with a null end, count for nothing.
    """
    links = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    links, before = stored(links), None
    for _ in range(rounds):
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            return links.select(F.col("u").alias("node"), F.col("v").alias("head")).union(links.select("v", "v").distinct())
        up = stored(_rehung(links, True).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        down = stored(_rehung(up, False).distinct())
        drop_stored(links)
        drop_stored(up)
        links, before = down, now
    raise RuntimeError("the groups did not settle")
