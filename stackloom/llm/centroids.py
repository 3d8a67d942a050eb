"""Centroid clustering with the threshold algorithm, in exact integers.

The centroids' values are kept as one sorted list per dimension. For a vector the lists are
walked outward from its own value, one entry of each list a round, the nearer side first; a
centroid met for the first time is measured exactly. Whatever was not met yet is at least as far
away as the frontiers together, so the walk ends when the sum of their squared distances
strictly exceeds the best exact distance (strictly, so that ties go to the smaller number).

Vectors stay where they are: each round sends k x dimensions sums of a partition to the next
stage, and only the k centroids (a bound set by the caller, not by the data) reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackloom.llm.tables import materialize

#: Vectors that walk the lists side by side.
BLOCK = 1024
#: Components up to this size have squared distances that a long holds, in up to 128 dimensions.
MOST = 1 << 27


class SortedLists:
    """Centroids as one sorted list of values for each dimension."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.order = np.argsort(centroids, axis=0, kind="stable")
        self.values = np.take_along_axis(centroids, self.order, axis=0)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number, squared distance) of each vector's nearest centroid, and how many exact
        distances that took."""
        n, k = len(vectors), len(self.centroids)
        best, which = np.full(n, np.iinfo(np.int64).max), np.full(n, k)
        above = np.column_stack([np.searchsorted(self.values[:, j], vectors[:, j]) for j in range(vectors.shape[1])])
        below, dims = above - 1, np.arange(vectors.shape[1])
        met, open_, measured = np.zeros((n, k), bool), np.arange(n), 0
        while len(open_):
            x, low, high = vectors[open_], below[open_], above[open_]
            down = np.where(low >= 0, x - self.values[np.maximum(low, 0), dims], np.iinfo(np.int64).max)
            up = np.where(high < k, self.values[np.minimum(high, k - 1), dims] - x, np.iinfo(np.int64).max)
            lower = down <= up
            entry = self.order[np.where(lower, low, high), dims]
            new = np.zeros((len(open_), k), bool)
            new[np.arange(len(open_))[:, None], entry] = True
            new &= ~met[open_]
            met[open_] |= new
            row, centroid = np.nonzero(new)
            measured += len(row)
            away = ((x[row] - self.centroids[centroid]) ** 2).sum(axis=1)
            distances = np.full((len(open_), k), np.iinfo(np.int64).max)
            distances[row, centroid] = away
            nearest = distances.argmin(axis=1)  # the first, so the smallest number, of equals
            distance = distances[np.arange(len(open_)), nearest]
            closer = (distance < best[open_]) | (distance == best[open_]) & (nearest < which[open_])
            best[open_[closer]], which[open_[closer]] = distance[closer], nearest[closer]
            below[open_], above[open_] = low - lower, high + ~lower
            frontier = (np.minimum(down, up) ** 2).sum(axis=1)
            open_ = open_[(frontier <= best[open_]) & ~met[open_].all(axis=1)]
        return which, best, measured


def _blocks(batches: Iterator[pa.RecordBatch], dim: int, column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part, part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _totals(lists: SortedLists, dim: int):
    """Rows and sums of each cluster and dimension of a partition."""

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(lists.centroids)
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for _, x in _blocks(batches, dim, 0):
            which = lists.nearest(x)[0]
            counts += np.bincount(which, minlength=k)
            np.add.at(sums, which, x)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(some, dim), pa.int32()), pa.array(np.tile(np.arange(dim), len(some)), pa.int32()), pa.array(np.repeat(counts[some], dim)), pa.array(sums[some].ravel())],
            ["cluster", "dim", "n", "total"],
        )

    return totals


def _assigned(lists: SortedLists, dim: int):
    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, dim, 1):
            which, best, _ = lists.nearest(x)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(which, pa.int32()), pa.array(best)], ["id", "cluster", "distance"])

    return assigned


def grid(vector: Column, scale: int = 64) -> Column:
    """floor(scale * component) of each component, as long."""
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(F.lit(float(scale)) * x))


def finite(vector: Column) -> Column:
    """Whether a vector is not null and all its components are finite numbers."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def cluster_vectors(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid): Lloyd's rounds on integer
    vectors floor(64 * component), distances squared Euclidean.

    Centroids start as the k vectors with the smallest sha256 of `seed:id` (equal ids: the
    smaller vector first; with fewer than k vectors there are as many centroids). Each round
    assigns every vector to its nearest centroid, ties to the smaller number, and replaces each
    centroid that has vectors by the floor of their mean; then vectors are assigned once more.
    Vectors that are null, of another length than `dim`, or hold null or non-finite components
    take no part. A null id is no starting centroid but is assigned. Repeated rows each count and
    each give a row; an empty table gives no rows. Components beyond 2,000,000 are refused with
    a ValueError: longs could not hold their distances. Extra columns are ignored.
    """
    spark = vectors.sparkSession
    id_type = vectors.schema[id_col].dataType.simpleString()
    v = F.col(vector_col)
    kept = vectors.filter((F.size(v) == dim) & finite(v)).select(F.col(id_col).alias("id"), grid(v).alias("x"))
    kept = materialize(kept, "grid")
    extent = kept.agg(F.max(F.greatest(F.abs(F.array_max("x")), F.abs(F.array_min("x"))))).first()[0]
    if extent is not None and extent > MOST:
        raise ValueError(f"a component of {extent} is too large for exact distances")
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = kept.select(place.alias("place"), "x").filter("place is not null").orderBy("place", "x").limit(k).collect()
    schema = f"id {id_type}, cluster int, distance long"
    if not first:
        return spark.createDataFrame([], f"{id_col} {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>")
    centroids = np.array([r.x for r in first], np.int64)
    for _ in range(rounds):
        found = kept.select("x").mapInArrow(_totals(SortedLists(centroids), dim), "cluster int, dim int, n long, total long")
        for r in found.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():  # k x dim rows at most
            centroids[r.cluster, r.dim] = r.total // r.n
    assigned = materialize(kept.mapInArrow(_assigned(SortedLists(centroids), dim), schema), "assigned")
    inertia = {r.cluster: r.total for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    of_cluster = [(c, inertia[c], sum(inertia.values()), centroids[c].tolist()) for c in sorted(inertia)]
    facts = spark.createDataFrame(of_cluster, "number int, cluster_inertia long, inertia long, centroid array<long>")
    joined = assigned.join(F.broadcast(facts), F.col("cluster") == F.col("number"))  # k rows at most
    return joined.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def centroid_digest(centroid: list[int]) -> str:
    """Lowercase hex sha256 of the components as decimal integers joined by commas."""
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()
