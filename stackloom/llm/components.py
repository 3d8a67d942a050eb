"""Connected components of an edge table: union-find inside partitions, then alternating
large-star and small-star rounds between them. No link list reaches the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackloom.llm.tables import materialize


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces a partition's edges by links from each node to the smallest of its tree."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if root(x) != x]
    for at in range(0, len(nodes), 50_000):
        part = nodes[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], ["u", "v"])


def _open(pairs: DataFrame) -> bool:
    """Whether some node links to two others, or to one that links on."""
    links = pairs.groupBy("u").agg(F.min("v").alias("v"), F.max("v").alias("w"))
    onward = links.select(F.col("v").alias("u"))
    return not links.filter("v != w").select("u").union(links.join(onward, "u", "left_semi").select("u")).isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges(a, b): label is the smallest node reachable.

    Self loops and repeated edges are allowed; rows with a null end are dropped. Nodes
    without an edge are not returned.
    """
    pairs = edges.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v")).dropna()
    pairs = materialize(pairs.mapInArrow(_forest, "u long, v long"), "edges")
    while _open(pairs):
        # large star: each node links its larger neighbours to the smallest it knows
        both = pairs.union(pairs.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large, "edges")
        # small star: each node links its smaller neighbours, and itself, to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
        pairs = materialize(small.filter("u > v").repartition("u").mapInArrow(_forest, "u long, v long"), "edges")
    labels = pairs.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label")
    return labels.union(pairs.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
