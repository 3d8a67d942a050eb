"""K-d tree partitioning of a document table into shards of near-equal bytes.

The points are groups of documents with equal texts (copies stay together), weighted by
their bytes. Every metadata dimension is cut into CELLS cells: numbers by their range, strings
by the byte-weighted quantiles of their whole values. Within a cell points lie in hashed order,
so a point's key is one number per dimension. Every node is split along its widest dimension
(largest byte-weighted deviation) at the weighted median: a distributed histogram of keys,
summed up in a window, names the bin of the median, and a second one inside that bin makes it
exact. A level of the tree costs three jobs however many nodes it has; the driver gets a row
for each node and step, and holds the tree as a few arrays of numbers, which tasks walk.

A group that alone exceeds LARGE of a leaf's share is placed before the light ones: it goes
whole into the leaf with most room, or, if it is larger than a leaf, its copies are dealt
over several leaves. Splits then use the quantile that gives each side what is left of its
leaves' room, which is the median where no large group is involved.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackloom.llm.numbering import hashed, number_within
from stackloom.llm.tables import broadcast_if_small, materialize

#: A group of equal texts with more than this share of a leaf is placed on its own.
LARGE = 1 / 64
#: A key has so many bits: the cell's, then those of the place inside it. A histogram has 2**STEP bins.
CELL_BITS, KEY_BITS, STEP = 10, 30, 15
CELLS = 1 << CELL_BITS

_GROUP = ["size", "text_crc32", "h1"]


class Tree:
    """Node 0 is the root. An inner node has a dimension and a cut: keys below it go left."""

    def __init__(self, leaves: int):
        self.dim, self.cut, self.left, self.right = [-1], [0], [0], [0]
        self.leaves, self.depth = [(0, leaves)], 0

    def open_nodes(self) -> list[int]:
        return [i for i, (a, b) in enumerate(self.leaves) if b - a > 1 and self.dim[i] < 0]

    def split(self, node: int, dim: int, cut: int) -> None:
        a, b = self.leaves[node]
        self.dim[node], self.cut[node] = dim, cut
        self.left[node], self.right[node] = len(self.dim), len(self.dim) + 1
        for part in ((a, a + (b - a) // 2), (a + (b - a) // 2, b)):
            self.dim.append(-1)
            self.cut.append(0)
            self.left.append(0)
            self.right.append(0)
            self.leaves.append(part)

    def arrays(self) -> dict[str, np.ndarray]:
        return {"dim": np.array(self.dim, np.int32), "cut": np.array(self.cut, np.int64), "left": np.array(self.left, np.int32), "right": np.array(self.right, np.int32), "leaf": np.array([a for a, _ in self.leaves], np.int32)}


def _walk(tree: dict[str, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The node in which each row of keys (rows, dimensions) ends."""
    node, rows = np.zeros(len(keys), np.int32), np.arange(len(keys))
    while len(keys) and (tree["dim"][node] >= 0).any():
        dim = tree["dim"][node]
        goes_left = keys[rows, np.maximum(dim, 0)] < tree["cut"][node]
        node = np.where(dim < 0, node, np.where(goes_left, tree["left"][node], tree["right"][node]))
    return node


def _keys_of(cells: pa.Array, place: pa.Array, dims: int) -> np.ndarray:
    """(rows, dimensions) keys from the cells, one after another, and the place's hash."""
    inside = KEY_BITS - CELL_BITS
    low = place.to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - inside)
    flat = cells.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)
    return (flat << inside) + low.astype(np.int64)[:, None]


def _cells(documents_like: DataFrame, numbers: list[str], strings: list[str], low: dict, high: dict, bounds: dict[str, list[tuple[str, int]]], then: Callable | None = None, schema: str = "") -> DataFrame:
    """documents_like with `cells`, an array of one cell for each dimension, numbers first; or,
    with `then`, the batches of that schema which it makes of these, in the same Python worker."""
    shipped = documents_like.sparkSession.sparkContext.broadcast({n: (np.array([v for v, _ in bounds[n]], object), np.array([0, *(c for _, c in bounds[n])])) for n in strings})
    rest = [c for c in documents_like.columns if c not in {f"at_{n}" for n in (*numbers, *strings)}]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = shipped.value
        for batch in batches:
            found = []
            for n in numbers:
                x = batch.column(f"at_{n}").to_numpy(zero_copy_only=False)
                found.append(np.floor((x - low[n]) / max(high[n] - low[n], 1e-300) * (CELLS - 1)).clip(0, CELLS - 1).astype(np.int32))
            for n in strings:
                coded = batch.column(f"at_{n}").dictionary_encode()
                at, cell = edges[n]
                values = cell[np.searchsorted(at, np.array(coded.dictionary.to_pylist(), object), "right")]
                found.append(values[coded.indices.to_numpy(zero_copy_only=False)].astype(np.int32))
            flat = np.column_stack(found).ravel()
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(found))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.ListArray.from_arrays(offsets, pa.array(flat))], [*rest, "cells"])

    if then is not None:
        return documents_like.mapInArrow(lambda batches: then(cut(batches)), schema)
    kinds = ", ".join(f"`{c}` {documents_like.schema[c].dataType.simpleString()}" for c in rest)
    return documents_like.mapInArrow(cut, f"{kinds}, cells array<int>")


def _bounds(points: DataFrame, strings: list[str]) -> dict[str, list[tuple[str, int]]]:
    """For each string dimension at most CELLS of its values and their cells, byte-weighted
    quantiles in code-point order. Distinct values are summed first, then prefix-summed by ranges."""
    if not strings:
        return {}
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("d"), F.col(f"at_{n}").alias("value")) for i, n in enumerate(strings))))
    values = points.select(each.alias("x"), "bytes").groupBy("x.d", "x.value").agg(F.sum("bytes").alias("bytes"))
    values = materialize(values.repartitionByRange("d", "value").withColumn("part", F.spark_partition_id()), "values")
    sums = values.groupBy("d", "part").agg(F.sum("bytes").alias("part_bytes"))
    before = F.sum("part_bytes").over(Window.partitionBy("d").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("d", "part", F.coalesce(before, F.lit(0)).alias("before"), F.sum("part_bytes").over(Window.partitionBy("d")).alias("total"))
    inside = F.sum("bytes").over(Window.partitionBy("d", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1))
    ranked = values.withColumn("inside", F.coalesce(inside, F.lit(0))).join(sums, ["d", "part"])
    cell = F.floor((F.col("before") + F.col("inside")) * (CELLS - 1) / F.col("total"))
    found: dict[str, list[tuple[str, int]]] = {n: [] for n in strings}
    for r in ranked.groupBy("d", cell.alias("cell")).agg(F.min("value").alias("value")).orderBy("d", "value").collect():
        found[strings[r.d]].append((r.value, r.cell))
    return found


def _tagged(points: DataFrame, dims: int, tree: Tree, ask: dict[int, tuple[int, int, int]] | None = None) -> DataFrame:
    """(node, bytes, and either the cells, or the bin of a histogram) of light points in open nodes.

    ask: node -> (dimension, prefix, step): the key's bits above the step must be the prefix.
    """
    shape = tree.arrays()
    if ask is not None:
        wanted = np.full((len(tree.dim), 3), -1, np.int64)
        for node, x in ask.items():
            wanted[node] = x
        shape["ask"] = wanted
    else:
        shape["open"] = np.isin(np.arange(len(tree.dim)), tree.open_nodes())
    shipped = points.sparkSession.sparkContext.broadcast(shape)

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for batch in batches:
            keys = _keys_of(batch.column("cells"), batch.column("place"), dims)
            node = _walk(own, keys)
            if "ask" in own:
                dim, prefix, step = own["ask"][node].T
                key = keys[np.arange(len(keys)), np.maximum(dim, 0)]
                keep = (dim >= 0) & ((key >> (KEY_BITS - STEP * np.maximum(step, 0))) == prefix)
                column = pa.array((key >> (KEY_BITS - STEP * (np.maximum(step, 0) + 1)))[keep])
            else:
                keep = own["open"][node]
                flat = batch.column("cells").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)[keep]
                column = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * dims), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(node[keep]), batch.column("bytes").filter(pa.array(keep)), column], ["node", "bytes", "x"])

    return points.select("cells", "place", "bytes").mapInArrow(tag, "node int, bytes long, x " + ("long" if ask is not None else "array<int>"))


def _cuts(points: DataFrame, dims: int, tree: Tree, wanted: dict[int, tuple[int, float]]) -> dict[int, int]:
    """For each node the key of a dimension with about `wanted` bytes before it."""
    spark = points.sparkSession
    cuts, ask, goals = {}, {n: (d, 0, 0) for n, (d, _) in wanted.items()}, {n: g for n, (_, g) in wanted.items()}
    for step in range(KEY_BITS // STEP):
        bins = _tagged(points, dims, tree, ask).groupBy("node", "x").agg(F.sum("bytes").alias("bytes"))
        goal = spark.createDataFrame([(n, float(goals[n])) for n in ask], "node int, goal double")
        upto = F.sum("bytes").over(Window.partitionBy("node").orderBy("x"))
        after = bins.withColumn("upto", upto).join(broadcast_if_small(goal, 16, len(ask)), "node")
        found = {r.node: r for r in after.groupBy("node").agg(F.min(F.when(F.col("upto") > F.col("goal"), F.struct("x", "bytes", "upto"))).alias("at"), F.max("x").alias("last")).collect()}
        shift = KEY_BITS - STEP * (step + 1)
        for n in list(ask):
            r = found.get(n)
            if r is None or r["at"] is None:  # nothing, or all of it, lies before the goal
                cuts[n] = 0 if r is None else (r["last"] + 1) << shift
                ask.pop(n)
                continue
            cuts[n] = r["at"]["x"] << shift
            goals[n] -= r["at"]["upto"] - r["at"]["bytes"]
            ask[n] = (ask[n][0], r["at"]["x"], step + 1)
        if not ask:
            break
    return cuts


def _deal(large: list, count: int, leaf: float) -> tuple[list[float], list[tuple]]:
    """(room left in each leaf, (group, leaves with their share upto)) for groups, largest first."""
    room = [(-leaf, i) for i in range(count)]
    heapq.heapify(room)
    dealt = []
    for r in sorted(large, key=lambda r: (-r.bytes, r.h1)):
        left, parts = r.copies, []
        while left:
            free, best = heapq.heappop(room)
            take = left if r.bytes <= leaf else min(left, max(1, int(-free // r["size"])))
            left -= take
            parts.append(((r.copies - left) / r.copies, best))
            heapq.heappush(room, (free + take * r["size"], best))
        dealt.append((*(r[k] for k in _GROUP), [{"upto": a, "leaf": b} for a, b in parts]))
    return [-free for free, _ in sorted(room, key=lambda x: x[1])], dealt


def kd_shards(
    documents: DataFrame,
    shards: int | None = 8,
    target_bytes: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    dimensions: dict[str, Column] | None = None,
) -> DataFrame:
    """(id, size, text_crc32, shard, slot) for every row of documents.

    size is the UTF-8 bytes of the text (null: none) plus 1, text_crc32 the CRC-32 of those
    bytes. Shards are 0 .. shards-1, or with shards=None as many as target_bytes asks for. slot
    counts a shard's rows from 0 without gaps, in hashed order, so a shard read by slot is
    shuffled. dimensions: what to split by, from the columns of documents, numbers or strings;
    the default is the length, the source and the language. A null coordinate counts as the
    least. The driver holds a few numbers for each shard, and the large groups, which are 64
    for each shard at most.

    Null and empty texts have size 1 and form one group. Ids may be null or repeated. An
    empty table gives no rows. Extra columns are ignored.
    """
    if dimensions is None:
        dimensions = {"length": F.log2(F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + F.lit(1.0))}
        dimensions |= {c: F.col(c) for c in ("source", "lang") if c in documents.columns}
    kinds = dict(documents.select(*(c.alias(n) for n, c in dimensions.items())).dtypes)
    strings = [n for n in dimensions if kinds[n] == "string"]
    numbers = [n for n in dimensions if n not in strings]
    names = [*numbers, *strings]
    least = {n: F.coalesce(dimensions[n], F.lit("")) if n in strings else F.coalesce(dimensions[n].cast("double"), F.lit(0.0)) for n in names}
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8")
    rows = documents.select(
        F.col(id_col).alias("id"),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.xxhash64(raw).alias("h1"),
        *(least[n].alias(f"at_{n}") for n in names),
    )
    rows = materialize(rows, "sized")
    place = F.xxhash64("h1", "text_crc32").alias("place")
    points = materialize(rows.groupBy(*_GROUP).agg(F.count("*").alias("copies"), F.sum("size").alias("bytes"), place, *(F.min(f"at_{n}").alias(f"at_{n}") for n in names)), "points")
    ends = points.agg(F.sum("bytes").alias("bytes"), *(f(f"at_{n}").alias(f"{k}_{n}") for n in numbers for k, f in (("low", F.min), ("high", F.max)))).first()
    if ends["bytes"] is None:
        return rows.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    count = shards or max(1, -(-ends["bytes"] // target_bytes))
    leaf = ends["bytes"] / count
    scale = [numbers, strings, {n: ends[f"low_{n}"] for n in numbers}, {n: ends[f"high_{n}"] for n in numbers}, _bounds(points, strings)]
    points = materialize(_cells(points, *scale), "celled")

    is_large = F.col("bytes") > leaf * LARGE
    room, dealt = _deal(points.filter(is_large).select(*_GROUP, "copies", "bytes").collect(), count, leaf)
    upto = np.concatenate(([0.0], np.cumsum(np.maximum(room, 0.0))))
    light, dims, tree = points.filter(~is_large), len(names), Tree(count)
    while nodes := tree.open_nodes():
        x = [F.col("x")[i] for i in range(dims)]
        moments = [f for i in range(dims) for f in (F.sum(F.col("bytes") * x[i]).alias(f"m{i}"), F.sum(F.col("bytes").cast("double") * x[i] * x[i]).alias(f"s{i}"))]
        seen = {r.node: r for r in _tagged(light, dims, tree).groupBy("node").agg(F.sum("bytes").alias("bytes"), *moments).collect()}
        wanted = {}
        for node in nodes:
            a, b = tree.leaves[node]
            left, both = upto[a + (b - a) // 2] - upto[a], upto[b] - upto[a]
            r = seen.get(node)
            spread = [r[f"s{i}"] / r.bytes - (r[f"m{i}"] / r.bytes) ** 2 for i in range(dims)] if r else [0.0]
            wanted[node] = (int(np.argmax(spread)), (r.bytes if r else 0) * float(left / both if both else 0.5))
        for node, cut in _cuts(light, dims, tree, wanted).items():
            tree.split(node, wanted[node][0], cut)

    shipped = rows.sparkSession.sparkContext.broadcast(tree.arrays())

    def place_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for batch in batches:
            shard = own["leaf"][_walk(own, _keys_of(batch.column("cells"), batch.column("place"), dims))]
            kept = [n for n in batch.schema.names if n not in ("cells", "place")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(shard)], [*kept, "shard"])

    # Each row finds its own leaf: rows of one text may differ in metadata, so the group's leaf
    # comes by a join for those texts that more than one row has, and for the large ones.
    group_kinds = "size long, text_crc32 long, h1 long"
    several = points.filter((F.col("copies") > 1) & ~is_large).select(*_GROUP, "cells", "place").mapInArrow(place_in, f"{group_kinds}, shard int")
    several = several.select(*_GROUP, F.array(F.struct(F.lit(1.0).alias("upto"), F.col("shard").alias("leaf"))).alias("parts"))
    parts = rows.sparkSession.createDataFrame(dealt, f"{group_kinds}, parts array<struct<upto:double,leaf:int>>")
    placed_groups = materialize(several.union(parts), "placed-groups")
    own = _cells(rows.withColumn("place", place), *scale, then=place_in, schema=f"id {rows.schema['id'].dataType.simpleString()}, {group_kinds}, shard int")
    joined = own.join(broadcast_if_small(placed_groups, 64), _GROUP, "left")
    draw = hashed(F.col("id"), "deal") / F.lit(float(1 << 28))
    mine = F.filter("parts", lambda p: draw < p["upto"])
    shard = F.when(F.col("parts").isNull(), F.col("shard")).otherwise(F.get(mine, F.lit(0))["leaf"])
    placed = joined.select("id", "size", "text_crc32", shard.alias("shard"))
    slotted = number_within(placed, ["shard"], [], ["id", "size", "text_crc32"], hashed(F.col("id"), "slot"), "slot")
    return slotted.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("slot") - 1).cast("long").alias("slot"))
