"""Centroid clustering of integer vectors in JVM expressions only.

The vectors are turned into integers once and kept as a table. A round is one pass over it: `zip_with` and
`aggregate` give the squared distances to the literal centroid arrays, `array_min` of (distance, number)
structs chooses the cluster, and one sum per column and cluster, added up within every task before the
exchange, gives the new centroids. What an exchange or the driver sees are k rows of sums from each task or
in all, however many vectors there are, and however many of them are equal.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: Largest integer component: the sum of 64 squared differences of such numbers still fits a long.
LARGEST = 1 << 27


def integer_vectors(df: DataFrame, size: int, scale: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): floor(scale * x) of the vectors that have exactly `size` components, none null or non-finite."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = df.select(F.col(id_col).alias("vec_id"), x.alias("x"), ((F.size(x) == size) & finite).alias("whole")).where("whole")
    whole = F.transform("x", lambda c: F.floor(scale * c))
    fits = F.forall(whole, lambda c: F.abs(c) <= LARGEST)
    return rows.select("vec_id", F.when(fits, whole).otherwise(F.raise_error(F.lit(f"a component is over {LARGEST} / {scale}"))).cast("array<bigint>").alias("v"))


def first_centroids(vectors: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The vectors with the k smallest sha256 of salt:<vec_id>; of one id, those with the smaller components first."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [list(r.v) for r in vectors.select(digest.alias("digest"), "v").orderBy("digest", "v").limit(k).collect()]


def nearest(v: Column, centroids: list[list[int]]) -> Column:
    """struct<distance, cluster> of the nearest centroid; of equal distances the smaller number wins."""
    literal = lambda c: F.lit(c).cast("array<bigint>")
    distance = lambda c: F.aggregate(F.zip_with(v, literal(c), lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda s, d: s + d)
    return F.array_min(F.array(*[F.struct(distance(c).alias("distance"), F.lit(i).alias("cluster")) for i, c in enumerate(centroids)]))


def moved(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round: the exact floor of each column's mean; those without vectors stay."""
    near = vectors.select("v", nearest(F.col("v"), centroids)["cluster"].alias("cluster"))
    # decimals: sums of very many components outgrow a long
    columns = near.select("cluster", *[F.col("v")[i].cast("decimal(18,0)").alias(f"c{i}") for i in range(len(centroids[0]))])
    sums = columns.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in columns.columns[1:]]).collect()
    out = list(centroids)
    for row in sums:
        out[row.cluster] = [int(x) // row.n for x in row[2:]]
    return out


def cluster_vectors(df: DataFrame, size: int = 64, k: int = 8, rounds: int = 10, scale: int = 1024, salt: str = "3", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector kept.

    Null vectors, vectors of another size, with a null or a non-finite component are left out; null and repeated ids are
    vectors of their own. With fewer than k vectors there are as many centroids as vectors. Ties of distance go to the
    smaller number. Equal vectors always share a cluster. A component whose integer is over LARGEST is an error, not
    a wrong distance; so is an inertia beyond a long. Other columns are not read, whatever their names; an empty table
    gives no rows.
    """
    vectors = materialize(integer_vectors(df, size, scale, id_col, vector_col), "vectors")
    centroids = first_centroids(vectors, k, salt)
    none = "vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))]
    if not centroids:
        return vectors.select(*none).where("false")
    for _ in range(rounds):
        after = moved(vectors, centroids)
        if after == centroids:
            break  # every later round would give the same
        centroids = after
    out = materialize(vectors.select("vec_id", nearest(F.col("v"), centroids).alias("near")).select("vec_id", "near.cluster", "near.distance"), "clusters")
    discard(vectors)
    total = {r.cluster: int(r.total) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).alias("total")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    of = lambda values, kind: F.lit(values)[F.col("cluster")].cast(kind)
    return out.select(
        "vec_id", "cluster", "distance", of([total.get(i, 0) for i in range(len(centroids))], "long").alias("cluster_inertia"),
        F.lit(sum(total.values())).cast("long").alias("inertia"), of(digests, "string").alias("centroid_sha256"),
    )
