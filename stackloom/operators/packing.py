"""Packing of sized items into chunks under a limit."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pack_ordered(items: DataFrame, group: str, name: str, size: str, limit: int) -> DataFrame:
    """Adds `chunk`: items of a group, by name, fill a chunk until the next would exceed the
    limit. An item beyond the limit has a chunk of its own.

    The filling is a fold, so a group is one task's work, but it streams: its rows arrive
    sorted and only the running size is held."""

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held, chunk = object(), 0, 0
        for frame in frames:
            chunks = []
            for g, s in zip(frame[group], frame[size], strict=True):
                g = None if pd.isna(g) else g
                if g != last:
                    last, held, chunk = g, s, 0
                elif held + s > limit:
                    held, chunk = s, chunk + 1
                else:
                    held += s
                chunks.append(chunk)
            yield frame.assign(chunk=pd.Series(chunks, dtype="int32", index=frame.index))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema) + ", chunk int"
    return items.repartition(group).sortWithinPartitions(group, name).mapInPandas(fold, schema)


class FirstFit:
    """Bins in a tournament tree: each node holds the most room below it, so the first bin with
    room is found in log time."""

    def __init__(self, limit: int):
        self.limit, self.bins, self.leaves = limit, 0, 1
        self.room = array("q", (-1, -1))

    def _grow(self) -> None:
        old, n = self.room[self.leaves : self.leaves + self.bins], self.leaves * 2
        self.leaves, self.room = n, array("q", (-1,)) * (2 * n)
        self.room[n : n + len(old)] = old
        for i in range(n - 1, 0, -1):
            self.room[i] = max(self.room[2 * i], self.room[2 * i + 1])

    def place(self, size: int) -> int:
        """The bin that takes an item: the first with room, else a new one."""
        if self.room[1] >= size:
            i = 1
            while i < self.leaves:
                i *= 2
                if self.room[i] < size:
                    i += 1
            left = self.room[i] - size
        else:
            if self.bins == self.leaves:
                self._grow()
            i, left = self.leaves + self.bins, self.limit - size
            self.bins += 1
        self.room[i], at = left, i - self.leaves
        while i > 1:
            i //= 2
            self.room[i] = max(self.room[2 * i], self.room[2 * i + 1])
        return at


def pack_ffd(items: DataFrame, group: str, name: str, size: str, limit: int, part_items: int | None = None) -> DataFrame:
    """Adds `part` and `chunk`: items of a group, largest first (equal sizes by name), go to the
    first chunk that they leave within the limit, else to a new one. An item beyond the limit has a
    chunk of its own, into which nothing else goes but items without a size. Null and negative
    sizes count as 0; null groups are one group. All columns of items pass through the tasks' Python, the
    largest items together: leave contents out, or digest them before.

    A group is one part, whatever its size: first fit is a fold over its sorted items, which stream through one task
    that holds two numbers for each chunk. Only if part_items is given are larger groups dealt by hash into parts
    of about that many, each packed alone and numbered on; the packing is another one then. First fit leaves
    at most one chunk of a part half empty, so all parts together take at most 2 x (sum of sizes / limit) +
    items beyond the limit + one chunk for each part.
    """
    rows = items.withColumn("part", F.lit(0))
    if part_items:
        spread = lambda parts: F.pmod(F.xxhash64(name, size), parts).cast("int")
        counted = items.groupBy(F.col(group).alias("__group")).agg(F.ceil(F.count("*") / part_items).cast("int").alias("__parts"))
        counted = counted.filter("__parts > 1")  # what is joined are the few large groups
        rows = items.join(counted, F.col(group).eqNullSafe(F.col("__group")), "left")
        rows = rows.withColumn("part", F.when(F.col("__parts") > 1, spread(F.col("__parts"))).otherwise(0)).drop("__group", "__parts")
    rows = rows.withColumn("__size", F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)))

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, bins = object(), None
        for frame in frames:
            chunks = []
            for g, p, s in zip(frame[group], frame["part"], frame["__size"], strict=True):
                key = (None if pd.isna(g) else g, p)
                if key != last:
                    last, bins = key, FirstFit(limit)
                chunks.append(bins.place(int(s)))
            yield frame.drop(columns="__size").assign(chunk=pd.Series(chunks, dtype="int32", index=frame.index))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema) + ", part int, chunk int"
    # Tasks by group and part: a part is one sorted run of its task.
    packed = rows.repartition(group, "part").sortWithinPartitions(group, "part", F.desc("__size"), name)
    return packed.select(*items.columns, "part", "__size").mapInPandas(fold, schema)


def chunk_plan(packed: DataFrame, group: str, name: str, size: str) -> DataFrame:
    """(group, part, chunk, chunk_id, members, n_members, total_bytes): what each archive holds. Chunks
    are numbered on over the parts of a group, from 1."""
    chunks = packed.groupBy(group, "part", "chunk").agg(F.array_sort(F.collect_list(name)).alias("members"), F.count("*").alias("n_members"), F.coalesce(F.sum(size), F.lit(0)).alias("total_bytes"))
    last = packed.groupBy(group, "part").agg((F.max("chunk") + 1).alias("__n"))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = last.select(F.col(group).alias("__group"), F.col("part").alias("__part"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    joined = chunks.join(starts, F.col(group).eqNullSafe(F.col("__group")) & (F.col("part") == F.col("__part")))
    return joined.select(group, "part", "chunk", (F.col("__start") + F.col("chunk") + 1).cast("long").alias("chunk_id"), "members", "n_members", "total_bytes")
