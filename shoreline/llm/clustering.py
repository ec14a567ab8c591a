"""Centroid clustering of integer vectors by a tournament of bisectors.

A vector is nearer to centroid j than to i where ``2 x.(c_j - c_i) > |c_j|^2 - |c_i|^2``: the
normals ``2 (c_j - c_i)`` and thresholds of all pairs i < j are computed once a round, as
integers.  A vector meets the centroids in the order of their numbers; each of the k - 1
linear sign tests eliminates the loser, zero favours the smaller number.  Only the distance to
the winner is computed, exactly.

Every round is one pass over the stored integer vectors: a task keeps one sum a centroid, the
sums are added by Spark, and k x dims totals go to the driver.

Defined cases: vectors that are NULL, have not exactly ``dims`` components, or hold a NULL or
non-finite one take no part; nor are those clustered that have an integer component beyond
+-2**27 (their squared distances need not fit a long): they come with NULL in every column but
``vec_id``.  A NULL ``vec_id`` starts a centroid last of all, rows of one id in the order of their
vectors; repeated rows are vectors each; with fewer than ``k`` vectors each starts a
centroid; an inertia that no long holds is NULL; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoreline.llm.common import ship, stored

#: the largest integer component: sign tests and squared distances of 64 such stay below 2**63
MOST = 1 << 27


def integer_vectors(vectors: DataFrame, dims: int = 64, scale: int = 1024) -> DataFrame:
    """``(vec_id, x)``: the kept vectors as long integers ``floor(scale * component)``; ``x`` is
    NULL where one is beyond ``MOST``."""
    v = F.col("v")
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    kept = (vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
            .filter(v.isNotNull() & (F.size(v) == dims) & ~F.exists(v, bad)))
    over = F.exists(v, lambda c: F.abs(c) * F.lit(float(scale)) > F.lit(float(MOST - 1)))
    return kept.select("vec_id", F.when(~over, F.transform(v, lambda c: F.floor(c * F.lit(float(scale))).cast("long"))).alias("x"))


def bisectors(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``normal[i, j]`` and ``threshold[i, j]``: ``x`` is nearer to j than to i where ``x.normal > threshold``."""
    squares = (centroids * centroids).sum(axis=1)
    return 2 * (centroids[None] - centroids[:, None]), squares[None] - squares[:, None]


def winners(x: np.ndarray, normal: np.ndarray, threshold: np.ndarray) -> np.ndarray:
    """The nearest centroid's number for every row of ``x``."""
    best = np.zeros(len(x), np.int64)
    for j in range(1, len(threshold)):
        best[np.einsum("nd,nd->n", x, normal[best, j]) > threshold[best, j]] = j
    return best


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dims)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def first_centroids(x: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors of smallest sha256 of ``<seed>:<vec_id>``, in the order of the hashes."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = x.orderBy(name.asc_nulls_last(), "x").select("x").limit(k).collect()  # k vectors
    return np.array([r["x"] for r in rows], np.int64)


def next_centroids(x: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The exact floors of the componentwise means of each centroid's vectors; a centroid without any stays."""
    k, dims = centroids.shape
    normal, threshold = bisectors(centroids)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 1), np.int64)
        for b in _slices(batches):
            rows = _matrix(b.column(0), dims)
            best = winners(rows, normal, threshold)
            np.add.at(total[:, :dims], best, rows)
            total[:, dims] += np.bincount(best, minlength=k)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["at", "part"])

    parts = x.select("x").mapInArrow(totals, "at int, part long")
    total = np.zeros(k * (dims + 1), object)
    for r in parts.groupBy("at").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("s")).collect():  # k x (dims + 1) rows
        total[r["at"]] = int(r["s"])
    total = total.reshape(k, dims + 1)
    return np.array([[int(s) // t[dims] for s in t[:dims]] if t[dims] else c for t, c in zip(total, centroids.tolist())], np.int64)


def fit(x: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3) -> np.ndarray:
    """Centroids of the stored integer vectors ``x (vec_id, x)`` after ``rounds`` rounds."""
    centroids = first_centroids(x, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        was, centroids = centroids, next_centroids(x, centroids)
        if np.array_equal(was, centroids):
            break  # every further round would give the same
    return centroids


def assign(x: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``(vec_id, cluster, distance)``: each vector's nearest centroid and its squared distance."""
    normal, threshold = bisectors(centroids)
    kind = x.schema["vec_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            rows = _matrix(b.column(1), centroids.shape[1])
            best = winners(rows, normal, threshold)
            apart = rows - centroids[best]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best.astype(np.int32)), pa.array((apart * apart).sum(axis=1))],
                                             ["vec_id", "cluster", "distance"])

    return x.select("vec_id", "x").mapInArrow(each, f"vec_id {kind}, cluster int, distance long")


def _total(c: Column) -> Column:
    return F.sum(c.cast("decimal(38,0)")).try_cast("long")


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` for every kept
    row of ``vectors (vec_id, embedding)``.

    The driver and each task hold ``k * k * dims`` integers of the bisectors.
    """
    spark = vectors.sparkSession
    ship(spark)
    all_rows = stored(integer_vectors(vectors, dims, scale), "integers")
    x = all_rows.filter(F.col("x").isNotNull())
    centroids = fit(x, k, rounds, seed)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    if not len(centroids):
        empty = spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long")
        placed, names = empty, []
    else:
        placed = stored(assign(x, centroids), "assigned")
        names = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    sums = placed.groupBy("cluster").agg(_total(F.col("distance")).alias("cluster_inertia"))
    whole = placed.agg(_total(F.col("distance"))).scalar()
    named = spark.createDataFrame(names, "cluster int, centroid_sha256 string")
    about = F.broadcast(sums.join(named, "cluster").withColumn("inertia", whole))  # a row a cluster
    result = placed.join(about, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    beyond = all_rows.filter(F.col("x").isNull()).select(
        "vec_id", *[F.lit(None).cast(f.dataType).alias(f.name) for f in result.schema.fields[1:]])
    return result.unionByName(beyond)
