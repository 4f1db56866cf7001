"""Exact k-means over integer vectors with a table of pivot distances (LAESA).

The components become integers, ``floor(scale * x)``. A few of the first centroids are the
pivots: fixed for the whole run, chosen so that each lies far from the ones before it. The
squared distance of every vector to every pivot is computed once and stored beside the
vector. In each round the centroids' distances to the pivots are known to all tasks, and by
the triangle inequality ``max_p |d(v, p) - d(c, p)|`` bounds ``d(v, c)`` from below. The
centroid of the least bound gets its distance first; only centroids whose bound does not
exceed that distance get theirs. Distances are sums of integers, so ties are exact; the
bounds are floats and get a margin far above their rounding.

A round is one scan of the table: tasks add up their vectors per cluster, Spark adds up the
tasks' sums, and only ``k`` centroids ever reach the driver.

Defined results: vectors that are null, have another number of components, or hold a null,
a NaN or an infinity are left out; a null id is hashed as an empty text; repeated rows are
rows like any other (equal ids are taken in the order of their components where first
centroids are chosen); fewer than ``k`` vectors give as many centroids; an empty cluster
keeps its centroid; an empty table gives no rows. Components beyond +-2**27 are refused, as a
squared distance would no longer fit a long. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowsmith.llm.common import col
from rowsmith.plans import durable

DIM = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
PIVOTS = 8
SEED = 1
LIMIT = 1 << 27  # of a component: DIM * (2 * LIMIT)**2 fits a long
ROWS = 4_096  # vectors a task compares at once


def _quantised(vectors: DataFrame, id: str, vector: str, dim: int, scale: int) -> DataFrame:
    """``(id, v)`` of the usable vectors, as integers."""
    x = F.transform(col(vector), lambda e: e.cast("double"))
    bad = F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = vectors.select(col(id).alias("id"), x.alias("x")).filter(F.col("x").isNotNull() & (F.size("x") == dim) & ~bad)

    def whole(e: Column) -> Column:
        scaled = F.floor(e * F.lit(float(scale)))
        beyond = F.raise_error(F.lit(f"a component is beyond +-{LIMIT} and has no exact distance"))
        return F.when(F.abs(e * F.lit(float(scale))) <= LIMIT, scaled.cast("long")).otherwise(beyond.cast("long"))

    return rows.select("id", F.transform("x", whole).alias("v"))


def _first(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors of least hash of their id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    order = F.sha2(name.cast("binary"), 256)
    return np.array([r["v"] for r in rows.select(order.alias("h"), "v").orderBy("h", "v").limit(k).collect()], dtype=np.int64)


def far_apart(points: np.ndarray, n: int) -> np.ndarray:
    """``n`` of the points: the first, then always the one farthest from those taken."""
    taken = [0]
    near = _squared(points, points[:1])[:, 0]
    while len(taken) < min(n, len(points)) and near.max() > 0:
        taken.append(int(near.argmax()))
        near = np.minimum(near, _squared(points, points[taken[-1:]])[:, 0])
    return points[taken]


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all of ``a`` to a few ``b``."""
    out = np.empty((len(a), len(b)), dtype=np.int64)
    for j in range(len(b)):
        d = a - b[j]
        out[:, j] = np.einsum("ij,ij->i", d, d)
    return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _lists(values: np.ndarray) -> pa.Array:
    at = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values.reshape(-1)))


def _with_pivots(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            far = _squared(_matrix(b.column("v"), pivots.shape[1]), pivots)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), _lists(far)], names=["id", "v", "p"])

    return run


def nearest(v: np.ndarray, p: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Cluster and squared distance of every vector, and how many distances that took.

    ``p`` holds the stored squared distances of ``v`` to ``pivots``.
    """
    n, k = len(v), len(centroids)
    from_pivots = np.sqrt(_squared(centroids, pivots).astype(np.float64))
    own = np.sqrt(p.astype(np.float64))
    bound = np.zeros((n, k))
    for j in range(len(pivots)):
        np.maximum(bound, np.abs(own[:, j, None] - from_pivots[None, :, j]), out=bound)
    bound *= bound * (1 - 1e-9)
    bound -= 1e-3
    likely = bound.argmin(axis=1)
    diff = v - centroids[likely]
    best = np.einsum("ij,ij->i", diff, diff)
    cluster = likely.copy()
    left = bound <= best[:, None]
    left[np.arange(n), likely] = False
    done = n
    for c in range(k):
        rows = np.flatnonzero(left[:, c] & (bound[:, c] <= best))
        done += len(rows)
        diff = v[rows] - centroids[c]
        d = np.einsum("ij,ij->i", diff, diff)
        closer = (d < best[rows]) | ((d == best[rows]) & (c < cluster[rows]))
        best[rows[closer]], cluster[rows[closer]] = d[closer], c
    return cluster, best, done


def _sums(centroids: np.ndarray, pivots: np.ndarray):
    """A task's vectors added up per cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dim = centroids.shape
        total, count = np.zeros((k, dim), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for b in _blocks(batches):
            v = _matrix(b.column("v"), dim)
            cluster, _, _ = nearest(v, _matrix(b.column("p"), len(pivots)), centroids, pivots)
            count += np.bincount(cluster, minlength=k)
            order = np.argsort(cluster, kind="stable")
            held, start = np.unique(cluster[order], return_index=True)
            total[held] += np.add.reduceat(v[order], start, axis=0)
        has = np.flatnonzero(count)
        if len(has):
            yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(count[has]), _lists(total[has])], names=["cluster", "n", "v"])

    return run


def _assigned(centroids: np.ndarray, pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            v, p = _matrix(b.column("v"), centroids.shape[1]), _matrix(b.column("p"), len(pivots))
            cluster, distance, _ = nearest(v, p, centroids, pivots)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["id", "cluster", "distance"]
            )

    return run


def _moved(rows: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    parts = rows.select("v", "p").mapInArrow(_sums(centroids, pivots), "cluster long, n long, v array<long>")
    sums = [F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(centroids.shape[1])]
    out = centroids.copy()
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *sums).collect():
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(centroids.shape[1])]
    return out


def clusters(
    vectors: DataFrame,
    id: str = "vec_id",
    vector: str = "embedding",
    k: int = CLUSTERS,
    rounds: int = ROUNDS,
    n_pivots: int = PIVOTS,
    dim: int = DIM,
    scale: int = SCALE,
    seed: int = SEED,
) -> DataFrame:
    """``(id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` of every usable vector.

    The id column keeps its name. ``distance`` is squared; the inertias are its sums over the cluster and over all.
    """
    spark = vectors.sparkSession
    rows = _quantised(vectors, id, vector, dim, scale)
    start = _first(rows, k, seed)
    kind = vectors.select(col(id)).schema[0].dataType.simpleString()
    out = f"id {kind}, cluster int, distance long"
    if not len(start):
        empty = spark.createDataFrame([], f"{out}, cluster_inertia long, inertia long, centroid_sha256 string")
        return empty.withColumnRenamed("id", id)
    pivots = far_apart(start, n_pivots)
    rows = durable.written(rows.mapInArrow(_with_pivots(pivots), f"id {kind}, v array<long>, p array<long>"), "pivot-table")
    centroids = start
    for _ in range(rounds):
        centroids = _moved(rows, centroids, pivots)
    found = durable.written(rows.mapInArrow(_assigned(centroids, pivots), out), "assigned")
    # One row a centroid, k at most.
    inertia = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    inertia = inertia.withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy(F.lit(0))))
    names = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    named = spark.createDataFrame(names, "cluster int, centroid_sha256 string")
    facts = inertia.join(F.broadcast(named), "cluster")
    out = found.join(F.broadcast(facts), "cluster")
    return out.select(F.col("id").alias(id), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
