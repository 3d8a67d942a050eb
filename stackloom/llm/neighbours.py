"""Approximate nearest neighbours by collision counting.

Every vector is projected on a few random directions; one sorted array of projections per
direction is the whole index. A query opens a window centred on its own projection in each
array, counts in how many windows a vector lies, and widens all windows by virtual rehashing
(each widening only counts the new flanks). Vectors whose count reaches the collision
threshold are verified by exact inner product in double precision.

Rows are dealt into blocks of about BLOCK vectors; a block's arrays are built where the block
lies. The stated query set meets every block, in slices of a few query blocks, and keeps its
best few per block before they are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackloom.llm.tables import materialize

BLOCK, QUERY_BLOCK = 16_384, 512
#: Query blocks that meet an index block in one task, and the most tasks of a search.
SLICE, MOST_TASKS = 4, 20_000
#: Most directions, and about how many (whole orthonormal sets, at random); the share of them in whose windows a
#: candidate lies; the share of a block in a first window; the widening factor; and the share
#: of a block (and the multiple of k) that must be candidates before a search ends.
DIRECTIONS, USUAL, COLLISIONS, FIRST, WIDEN, SHARE, TIMES = 128, 96, 0.875, 0.7, 1.06, 0.08, 6
#: How far apart the arrays' values are kept; projections of unit vectors lie in [-1, 1].
APART = 4.0


class Block:
    """Sorted projection arrays over unit-length copies of a block's vectors.

    For the largest inner product vectors are first lifted to one length: an extra component
    completes each to the longest of the block, so that nearest means largest product.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, seed: int = 11):
        self.ids, self.vectors = ids, vectors
        squares = (vectors * vectors).sum(axis=1)
        longest = np.sqrt(squares.max())
        lifted = np.column_stack((vectors / longest, np.sqrt(np.maximum(0.0, 1 - squares / longest**2))))
        rng, d = np.random.default_rng(seed), lifted.shape[1]
        bases = [np.linalg.qr(rng.standard_normal((d, d)))[0] for _ in range(max(1, round(USUAL / d)))]
        self.directions = np.column_stack(bases)[:, :DIRECTIONS]
        projected = lifted @ self.directions
        # The arrays lie one after another, each shifted by APART, so that one search finds the
        # bounds of all windows.
        self.order = np.argsort(projected, axis=0, kind="stable").T.ravel()
        self.shifts = APART * np.arange(projected.shape[1])
        self.sorted = (np.sort(projected, axis=0) + self.shifts).T.ravel()
        self.longest = longest
        spans = np.quantile(projected, (0.5 - FIRST / 2, 0.5 + FIRST / 2), axis=0)
        self.start = max(float((spans[1] - spans[0]).mean() / 2), 1e-9)
        self.needed = int(np.ceil(COLLISIONS * self.directions.shape[1]))
        # Where searches for some of the block's own vectors ended is a better first radius.
        trials = [self._widened(v, 20)[1] for v in vectors[:: max(1, len(ids) // 16)]]
        self.start = max(self.start, float(np.median(trials)) / WIDEN)

    def candidates(self, query: np.ndarray, k: int) -> np.ndarray:
        return self._widened(query, k)[0]

    def _widened(self, query: np.ndarray, k: int) -> tuple[np.ndarray, float]:
        """Windows hold most of an array, so what is counted are the vectors outside of them:
        widening takes back those of the new flanks."""
        n, m, order = len(self.ids), len(self.shifts), self.order
        enough = min(n, max(int(SHARE * n), TIMES * k))
        centre = np.append(query / np.linalg.norm(query), 0.0) @ self.directions
        radius, misses, low, high = self.start, None, None, None
        while True:
            reach = np.clip((centre - radius, centre + radius), -APART / 2, APART / 2) + self.shifts
            a, b = (side.tolist() for side in self.sorted.searchsorted(reach))
            if misses is None:  # between one array's window and the next one's lies what both leave out
                flanks = [order[i:j] for i, j in zip([0, *b], [*a, n * m], strict=True)]
                misses = np.bincount(np.concatenate(flanks), minlength=n)
            else:
                flanks = [order[i:j] for x, y in ((a, low), (high, b)) for i, j in zip(x, y, strict=True)]
                misses -= np.bincount(np.concatenate(flanks), minlength=n)
            found = np.flatnonzero(m - misses >= self.needed)
            if len(found) >= enough or not misses.any():
                return found, radius
            radius, low, high = radius * WIDEN, a, b

    def nearest(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        found = self.candidates(query, k + 1)
        found = found[self.ids[found] != query_id]
        vectors = self.vectors[found]
        if len(found) > k:  # a quick product leaves those that rounding could bring among the best
            rough = vectors @ query
            slack = 8 * len(query) * np.finfo(float).eps * self.longest * np.linalg.norm(query)
            near = ~(rough < np.partition(rough, -k)[-k] - slack)
            found, vectors = found[near], vectors[near]
        scores = (vectors * query).sum(axis=1)
        best = np.lexsort((self.ids[found], -scores))[:k]
        return self.ids[found][best], scores[best]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(column[0].as_buffer(), np.float64).reshape(-1, dim)


def _packed(rows: DataFrame, block: Column, name: str) -> DataFrame:
    """One row for each block: its ids and its vectors, one after another, as bytes."""

    def pack(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values("id")
        vectors = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        return pd.DataFrame({"dim": [key[0]], name: [key[1]], "ids": [pdf["id"].to_numpy(np.int64).tobytes()], "vectors": [vectors.tobytes()]})

    return rows.withColumn("block", block).groupBy("dim", "block").applyInPandas(pack, f"dim int, {name} long, ids binary, vectors binary")


def _search(k: int):
    """Rows of a (dim, v_block, slice) arrive together: the block first, then its query blocks."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, block = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n).slice(i, 1) for n in batch.schema.names}
                dim, asks = row["dim"][0].as_py(), row["asks"][0].as_py()
                key = (dim, row["v_block"][0].as_py(), row["slice"][0].as_py())
                ids, vectors = np.frombuffer(row["ids"][0].as_buffer(), np.int64), _matrix(row["vectors"], dim)
                if not asks:
                    have, block = key, Block(ids, vectors)
                elif have == key:
                    found = [block.nearest(q, v, k) for q, v in zip(ids.tolist(), vectors, strict=True)]
                    repeated = np.repeat(ids, [len(near) for near, _ in found])
                    yield pa.RecordBatch.from_arrays([pa.array(repeated), pa.array(np.concatenate([x for x, _ in found])), pa.array(np.concatenate([x for _, x in found]))], ["query_id", "id", "score"])

    return search


def _numbers(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def nearest_neighbours(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): for each row that `queries` selects its k nearest rows
    found, by largest inner product, itself not among them; ties go to the smaller id.

    Vectors that are null, empty, zero or hold a null or non-finite component take no part,
    nor do rows with a null id; vectors of different lengths are not compared. Of rows that
    repeat an id one is used (the smallest vector). An empty table gives no rows. Extra
    columns are ignored.
    """
    wide = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = wide.filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(finite & F.exists("v", lambda x: x != 0))
    usable = usable.groupBy("id").agg(F.min("v").alias("v"), F.max("asks").alias("asks")).withColumn("dim", F.size("v"))
    usable = materialize(usable, "vectors")
    sizes = {(r.dim, r.asks): r.n for r in usable.groupBy("dim", "asks").agg(F.count("*").alias("n")).collect()}
    total, asking = sum(sizes.values()), sum(n for (_, asks), n in sizes.items() if asks)
    blocks, query_blocks = max(1, -(-total // BLOCK)), max(1, -(-asking // QUERY_BLOCK))
    slices = -(-query_blocks // SLICE)
    index = materialize(_packed(usable, F.pmod(F.xxhash64("id"), F.lit(blocks)), "v_block"), "index")
    asked = materialize(_packed(usable.filter("asks"), F.pmod(F.xxhash64("id"), F.lit(query_blocks)), "q_block"), "asked")
    # A block is sent, and its arrays are built, once for each slice of the queries.
    index = index.select("dim", "v_block", _numbers(slices).alias("slice"), F.lit(False).alias("asks"), "ids", "vectors")
    asked = asked.select("dim", _numbers(blocks).alias("v_block"), F.pmod("q_block", F.lit(slices)).alias("slice"), F.lit(True).alias("asks"), "ids", "vectors")
    tasks = max(int(usable.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(blocks * slices, MOST_TASKS))
    met = index.union(asked).repartition(tasks, "dim", "v_block", "slice").sortWithinPartitions("dim", "v_block", "slice", "asks")
    found = met.mapInArrow(_search(k), "query_id long, id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
