"""Clustering by centroids in integer arithmetic, wholly in JVM expressions.

A component x becomes the integer floor(scale * x), so sums, floors and ties are exact and no run
depends on the order of rows.  A round holds the centroids as literal arrays: ``zip_with`` and
``aggregate`` give the squared distance to each, ``array_min`` over structs of (distance, number)
chooses the nearest and settles ties, and one aggregation by cluster sums every component in a
column of its own.  What leaves a round is a row per cluster, k rows of ``dim`` numbers whatever
the table's size; the shuffle carries k partial rows a task.

Vectors are turned into integers once, in a table in the shared folder that the rounds read and
that goes when they are over; assignments are computed from the vectors themselves.

Defined cases: vectors that are null, have another number of components, or hold null or
non-finite ones take no part and give no row; repeated rows count each; rows that share an id
share their place in the order that picks the first centroids and come in order of their
components there, null ids last; fewer vectors than k give as many clusters; an empty table gives no row;
further columns are carried through by ``assign`` if asked for.  Components are limited to LARGEST
after scaling, as a long holds no distance beyond; a table with larger ones is refused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm._session import dropped, fresh_folder

#: Of 64 components the squared distances are then below 2^63.
LARGEST = 1 << 27
OWN = ("cluster", "distance")


def usable(vector: str, dim: int) -> Column:
    """Exactly ``dim`` components, none null or non-finite."""
    fit = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(vector) == dim) & F.forall(F.col(vector), fit), F.lit(False))


def integers(vector: str, scale: float) -> Column:
    return F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def nearest(v: str, centroids: Sequence[Sequence[int]]) -> Column:
    """struct(distance, cluster) of the nearest centroid, of equal ones the first."""
    literal = lambda c: f"array({', '.join(f'{int(x)}L' for x in c)})"
    far = lambda c: f"aggregate(zip_with({v}, {literal(c)}, (a, b) -> (a - b) * (a - b)), 0L, (s, x) -> s + x)"
    each = ", ".join(f"named_struct('distance', {far(c)}, 'cluster', {k})" for k, c in enumerate(centroids))
    return F.expr(f"array_min(array({each}))")


def first_centroids(held: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The k vectors with the smallest sha256 of seed and id."""
    key = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)
    return [list(r["v"]) for r in held.select(key.alias("key"), "v").orderBy(F.col("key").asc_nulls_last(), "v").limit(k).collect()]


def moved(held: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """One round: floor(sum / count) of every component and cluster; empty clusters stay."""
    dim = len(centroids[0])
    sums = held.select(nearest("v", centroids)["cluster"].alias("cluster"), "v").groupBy("cluster").agg(F.count("*").alias("n"), *[F.expr(f"sum(v[{j}]) AS s{j}") for j in range(dim)])
    out = [list(c) for c in centroids]
    for r in sums.collect():  # a row per cluster
        out[r["cluster"]] = [r[f"s{j}"] // r["n"] for j in range(dim)]
    return out


def fit(vectors: DataFrame, k: int = 8, dim: int = 64, rounds: int = 10, scale: float = 1024.0, seed: str = "3:", id_col: str = "vec_id", vector: str = "embedding") -> list[list[int]]:
    """The centroids after ``rounds`` rounds, in integers."""
    spark, folder = vectors.sparkSession, fresh_folder(vectors.sparkSession, "integers")
    vectors.where(usable(vector, dim)).select(F.col(id_col).cast("long").alias("id"), integers(vector, scale).alias("v")).write.parquet(folder)
    held = spark.read.parquet(folder)
    most = held.agg(F.max(F.greatest(F.array_max("v"), -F.array_min("v")))).first()[0]
    if most is not None and most > LARGEST:
        raise ValueError(f"components reach {most} after scaling, more than the {LARGEST} that exact distances allow")
    centroids = first_centroids(held, k, seed)
    for _ in range(rounds if centroids else 0):
        centroids = moved(held, centroids)
    dropped(spark, folder)
    return centroids


def assign(vectors: DataFrame, centroids: list[list[int]], scale: float = 1024.0, vector: str = "embedding") -> DataFrame:
    """Usable vectors with all their columns, cluster and squared distance (in place of columns of
    those names)."""
    rows = vectors.drop(*OWN)
    if not centroids:
        return rows.where(F.lit(False)).withColumns({"cluster": F.lit(0), "distance": F.lit(0).cast("long")})
    near = rows.where(usable(vector, len(centroids[0]))).withColumn("__tw_v", integers(vector, scale)).withColumn("__tw_n", nearest("__tw_v", centroids))
    return near.withColumns({"cluster": F.col("__tw_n.cluster"), "distance": F.col("__tw_n.distance")}).drop("__tw_v", "__tw_n")


def digest(centroid: Sequence[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def report(vectors: DataFrame, centroids: list[list[int]], scale: float = 1024.0, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every usable vector."""
    placed = assign(vectors.select(id_col, vector), centroids, scale, vector).select(id_col, "cluster", "distance")
    per = {r["cluster"]: r["d"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # a row per cluster
    told = F.array(*[F.struct(F.lit(per.get(k, 0)).cast("long").alias("inertia"), F.lit(digest(c)).alias("sha256")) for k, c in enumerate(centroids or [[]])])
    own = F.element_at(told, F.col("cluster") + 1)
    return placed.select(id_col, "cluster", "distance", own["inertia"].alias("cluster_inertia"), F.lit(sum(per.values())).cast("long").alias("inertia"), own["sha256"].alias("centroid_sha256"))


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: float = 1024.0, **how) -> DataFrame:
    """Fit to all vectors, then report each."""
    return report(vectors, fit(vectors, scale=scale, id_col=id_col, vector=vector, **how), scale, id_col, vector)
