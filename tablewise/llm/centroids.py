"""Centroid clustering on whole numbers (operator 12).

Vectors are scaled to whole numbers, so sums and distances are exact and do not
depend on the order of rows. Assignment is one JVM expression: ``zip_with`` and
``aggregate`` give the distance to each centroid, a literal array in the plan,
and ``array_min`` of (distance, number) chooses. The update is one aggregate of
column sums by cluster, partial before its shuffle. Each round reads the scaled
table once; the driver holds the centroids (clusters × components numbers).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import literal, save

#: Largest magnitude of a scaled component: 64 squared differences stay within 63 bits.
LARGEST = 1 << 27


def quantise(vectors: DataFrame, dims: int = 64, scale: int = 1024, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, q): floor(scale × x) of vectors with ``dims`` components, none null or non-finite; others take no part.

    A finite component beyond LARGEST / scale raises an error, as exact distances would not fit.
    """
    e = F.col(embedding).cast("array<double>")

    def whole(x: Column) -> Column:
        y = F.floor(x * float(scale))
        return F.when(F.abs(x * float(scale)) <= float(LARGEST), y).otherwise(F.raise_error(F.lit("component too large for exact distances")).cast("long"))

    kept = vectors.select(F.col(vec_id).alias("vec_id"), e.alias("e")).where((F.size("e") == dims) & F.forall("e", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))))
    return kept.select("vec_id", F.transform("e", whole).alias("q"))


def first_centroids(data: DataFrame, k: int = 8, seed: int = 3) -> list[list[int]]:
    """The vectors of the k smallest SHA-256 of ``seed:vec_id``; ties by the vector. A null id writes as the empty string."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [list(r.q) for r in data.select(key.alias("key"), "q").orderBy("key", "q").limit(k).collect()]


def nearest(q: Column, centroids: list[list[int]]) -> Column:
    """struct(distance, cluster) of the nearest centroid; ties go to the smaller number."""
    def distance(c: list[int]) -> Column:
        return F.aggregate(F.zip_with(q, literal(c, "array<bigint>"), lambda x, y: (x - y) * (x - y)), F.lit(0).cast("long"), lambda a, b: a + b)

    return F.array_min(F.array(*[F.struct(distance(c).alias("distance"), F.lit(i).alias("cluster")) for i, c in enumerate(centroids)]))


def update(data: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Centroids after one round: floor(sum / count) by component; those without vectors stay."""
    dims = range(len(centroids[0]))
    near = data.select(nearest(F.col("q"), centroids)["cluster"].alias("cluster"), *[F.col("q")[i].alias(f"x{i}") for i in dims])
    out = list(centroids)
    for r in near.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(f"x{i}").alias(f"x{i}") for i in dims]).collect():
        out[r.cluster] = [r[f"x{i}"] // r.n for i in dims]
    return out


def fit(data: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3) -> list[list[int]]:
    """Centroids of (vec_id, q) after ``rounds`` rounds."""
    centroids = first_centroids(data, k, seed)
    for _ in range(rounds if centroids else 0):
        centroids = update(data, centroids)
    return centroids


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Cluster of each vector and the inertia of the clustering.

    Returns vec_id, cluster, distance (squared, in scaled units), cluster_inertia,
    inertia and centroid_sha256 (of the final centroid's components, joined by
    commas). Null vectors, those of another length and those with null or
    non-finite components are left out; repeated rows count again; fewer than k
    vectors make fewer clusters; an empty table gives no rows; other columns are
    not looked at.
    """
    data = save(quantise(vectors, dims, scale, vec_id, embedding), "centroid-data")
    centroids = fit(data, k, rounds, seed)
    if not centroids:
        return data.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(x) for x in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    near = nearest(F.col("q"), centroids)
    out = save(data.select("vec_id", near.alias("near")).select("vec_id", "near.cluster", "near.distance"), "centroid-near")
    sums = {r.cluster: r.s for r in out.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    inertia = literal([sums.get(i, 0) for i in range(len(centroids))], "array<bigint>")
    digests = F.lit([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids])
    return out.select("vec_id", "cluster", "distance", inertia[F.col("cluster")].alias("cluster_inertia"), F.lit(sum(sums.values())).cast("long").alias("inertia"),
                      digests[F.col("cluster")].alias("centroid_sha256"))
