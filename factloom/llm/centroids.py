"""Centroid clustering of whole-numbered vectors in JVM expressions alone.

Components become integers, so sums, distances and centroids are exact and every run, partitioning and engine
gives the same clusters.  The centroids are literal arrays in the plan (k * size numbers, whatever the table's
size): ``zip_with`` and ``aggregate`` give the distance to each, ``array_min`` of structs the nearest, and one
generated column sum per component moves them.  A round is one scan with k partial rows per task.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

from factloom.llm.common import configure, written

#: A component beyond this counts as this, so that the squared distances of 512 components fit a long.
LARGEST = float(1 << 20)
LONG = 1 << 63


def grid(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, x in double precision."""
    inside = lambda x: F.greatest(F.least(x.cast("double"), F.lit(LARGEST)), F.lit(-LARGEST))
    return F.transform(vector, lambda x: F.floor(inside(x) * F.lit(float(scale))))


def whole(vector: Column, size: int) -> Column:
    """Exactly ``size`` components, none null or non-finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(vector) == size) & F.forall(vector, finite), F.lit(False))


def literal(centroids: list[list[int]]) -> Column:
    return F.expr("array(" + ", ".join("array(" + ", ".join(f"{x}L" for x in c) + ")" for c in centroids) + ")")


def nearest(vector: Column, centroids: list[list[int]]) -> Column:
    """Struct of the squared distance to the nearest centroid and its number, the smaller one of a tie."""

    def compared(centroid: Column, number: Column) -> Column:
        squares = F.zip_with(vector, centroid, lambda a, b: (a - b) * (a - b))
        return F.struct(F.aggregate(squares, F.lit(0).cast("long"), lambda total, x: total + x).alias("distance"), number.alias("cluster"))

    return F.array_min(F.transform(literal(centroids), compared))


def moved(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Floor of the mean of each centroid's vectors; one without vectors stays."""
    size = len(centroids[0])
    sums = [F.sum(F.get("_v", F.lit(i))).alias(f"s{i}") for i in range(size)]
    rows = vectors.select(nearest(F.col("_v"), centroids)["cluster"].alias("cluster"), "_v").groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect()
    new = list(centroids)
    for row in rows:
        new[row.cluster] = [row[f"s{i}"] // row.n for i in range(size)]
    return new


def cluster(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", size: int = 64, clusters: int = 16, rounds: int = 3, scale: int = 64, seed: str = "1"
) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector of exactly ``size`` finite components.

    Centroids 0, 1, ... start as the vectors with the smallest SHA-256 of ``seed:id``; of rows that repeat an id the
    one with the smallest components comes first, rows without id come last.  Each of ``rounds`` rounds assigns every
    vector and moves the centroids; then all are assigned once more.  Null, shorter and longer vectors and those with
    null or non-finite components are left out; repeated rows each count; with fewer vectors than ``clusters`` each
    starts a centroid; no vectors, no rows.  A component beyond 2^20 counts as 2^20, and an inertia that no long holds
    is null.  Other columns of the input, whatever their names, are not read.
    """
    configure(df.sparkSession)
    vectors = df.where(whole(F.col(vector_col), size)).select(F.col(id_col).alias("_id"), grid(F.col(vector_col), scale).alias("_v"))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_id").cast("string")), 256)
    first = vectors.select(order.alias("_h"), "_v").orderBy(F.asc_nulls_last("_h"), "_v").limit(clusters).collect()
    if not first:
        kinds = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return df.sparkSession.createDataFrame([], f"`{id_col}` {dict(df.dtypes)[id_col]}, {kinds}")
    centroids = [list(row["_v"]) for row in first]
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    assigned = written(vectors.select("_id", nearest(F.col("_v"), centroids).alias("_near")).select("_id", "_near.*"), "clusters")
    sums = {row.cluster: int(row.total) for row in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    of = lambda values: F.element_at(F.array(*values), F.col("cluster") + 1)
    long = lambda n: F.lit(n if n < LONG else None).cast("long")
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return assigned.select(
        F.col("_id").alias(id_col), F.col("cluster").cast("int").alias("cluster"), "distance",
        of([long(sums.get(i, 0)) for i in range(len(centroids))]).alias("cluster_inertia"),
        long(sum(sums.values())).alias("inertia"), of([F.lit(n) for n in names]).alias("centroid_sha256"),
    )
