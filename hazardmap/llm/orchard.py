"""Clusters of vectors round centroids, assigned by Orchard's search.

Every centroid has a list of the other centroids, nearest first.  A vector starts at centroid 0 and reads its list:
each centroid not visited yet is measured and marked; one that is closer (or as close with a smaller number) becomes
the current one and its list is read from the start; reading stops at a centroid strictly farther from the current one
than twice the vector's distance, since none after it can be as close.  All distances are exact integers, so ties
are real ties.  A batch of vectors takes these steps together in numpy.

Rounds read the integer components, written once to the shared folder; only the k sums of each round reach the driver.

Defined cases: vectors of another length, or with a null or non-finite component, are left out; repeated rows each get
their row; rows without an id can't start a centroid before those with one; fewer vectors than k give as many
centroids; an empty table gives an empty result; other columns stay, and those named like results are replaced.
Components beyond limit(dims), about 67 million for 64 of them, count as that limit, so that squares stay exact in 64 bits.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import keep


def limit(dims: int) -> int:
    """Components of this size still have squared distances, four times over, under 2**63."""
    return 1 << int((60 - math.ceil(math.log2(max(dims, 1)))) // 2 - 1)


def finite(vec: str) -> Column:
    """Is every component a finite number?"""
    return F.coalesce(F.forall(F.col(vec), lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))), F.lit(False))


def floored(vec: str, scale: int, most: int) -> Column:
    """Components as integers floor(scale * x), at most `most` from 0."""
    return F.transform(F.col(vec), lambda x: F.greatest(F.lit(-most), F.least(F.lit(most), F.floor(F.lit(float(scale)) * x.cast("double")))).cast("int"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column, whose rows all have dims components, as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def lists(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each centroid the others, nearest first (then by number), and their squared distances; a last entry ends every list."""
    k = len(centroids)
    between = ((centroids[:, None] - centroids[None]) ** 2).sum(-1)
    between[np.arange(k), np.arange(k)] = -1  # itself first
    order = np.argsort(between, axis=1, kind="stable")[:, 1:]
    far = np.take_along_axis(between, order, 1)
    end = np.full((k, 1), np.iinfo(np.int64).max)
    return np.hstack([order, np.zeros((k, 1), np.int64)]), np.hstack([far, end])


def search(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row of x (of equally near ones the smallest number) and the squared distance."""
    order, far = lists(centroids)
    n = len(x)
    at, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
    best = ((x - centroids[0]) ** 2).sum(1)
    visited = np.zeros((n, len(centroids)), bool)
    visited[:, 0] = True
    live = np.arange(n)
    while len(live):
        live = live[far[at[live], place[live]] <= 4 * best[live]]
        to = order[at[live], place[live]]
        place[live] += 1
        fresh = ~visited[live, to]
        i, j = live[fresh], to[fresh]
        visited[i, j] = True
        d = ((x[i] - centroids[j]) ** 2).sum(1)
        closer = (d < best[i]) | (d == best[i]) & (j < at[i])
        i, j = i[closer], j[closer]
        at[i], best[i], place[i] = j, d[closer], 0
    return at, best


def assigned(rows: DataFrame, centroids: list[list[int]], column: str) -> DataFrame:
    """rows with the struct __at: cluster and distance."""
    dims = len(centroids[0])

    @F.arrow_udf("struct<cluster:int,distance:long>")
    def nearest(v: pa.Array) -> pa.Array:
        cluster, distance = search(matrix(v, dims), np.array(centroids, np.int64))
        return pa.StructArray.from_arrays([pa.array(cluster.astype(np.int32)), pa.array(distance)], ["cluster", "distance"])

    return rows.withColumn("__at", nearest(F.col(column)))


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster_vectors(rows: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3, vec: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """Kept rows with cluster, distance (squared), cluster_inertia, inertia and centroid (its components).

    Centroids start as the k vectors whose "<seed>:<id>" has the least SHA-256 in hexadecimal.  Each round assigns all
    vectors and moves every centroid that has some to floor(sum / count); after the last one they are assigned again.
    A round that moves nothing ends the rounds, as all later ones would repeat it.
    """
    spark = rows.sparkSession
    kept = rows.where((F.size(vec) == dims) & finite(vec)).withColumn("__v", floored(vec, scale, limit(dims)))
    kept = keep(kept, "vectors")
    first = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(vec_id).cast("string")), 256)
    start = kept.select(first.alias("h"), "__v").orderBy(F.col("h").isNull(), "h", "__v").limit(k)
    centroids = [list(r["__v"]) for r in start.collect()]  # k rows
    names = ["cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    if not centroids:
        none = {"cluster": "int", "distance": "long", "cluster_inertia": "long", "inertia": "long", "centroid": "array<int>"}
        return kept.drop("__v", *names).withColumns({n: F.lit(None).cast(t) for n, t in none.items()})
    for _ in range(rounds):
        sums = assigned(kept.select("__v"), centroids, "__v").groupBy(F.col("__at.cluster").alias("c")).agg(F.count("*").alias("n"), *(F.sum(F.col("__v")[i].cast("long")).alias(f"s{i}") for i in range(dims)))
        moved = list(centroids)
        for r in sums.collect():  # k rows
            moved[r["c"]] = [r[f"s{i}"] // r["n"] for i in range(dims)]
        if moved == centroids:
            break
        centroids = moved
    final = keep(assigned(kept, centroids, "__v").drop("__v", *names), "assigned")
    by = {r[0]: r[1] for r in final.groupBy("__at.cluster").agg(F.sum("__at.distance")).collect()}  # k rows
    table = spark.createDataFrame([(c, n, sum(by.values()), centroids[c]) for c, n in by.items()], "__c int, cluster_inertia long, inertia long, centroid array<int>")
    met = final.join(F.broadcast(table), F.col("__at.cluster") == F.col("__c"))  # k rows
    return met.withColumns({"cluster": F.col("__at.cluster"), "distance": F.col("__at.distance")}).drop("__at", "__c")
