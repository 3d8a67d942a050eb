"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Within a source every document is expected target / source size times. Along the source's
documents, ordered by size, those expectations are prefix-summed; a random offset is added,
and a document is emitted once for each integer that its sum crosses. Ordering by size keeps
the words taken within about one document of each size class of the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackloom.llm.numbering import hashed, number_within
from stackloom.llm.tables import materialize

#: Resolution of the random offset.
_STEPS = 1 << 20


def count_words(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def size_class(size: str) -> Column:
    """The number of binary digits and the first four: classes an eighth of a doubling wide at most."""
    digits = F.bin(size)
    return F.length(digits) * 16 + F.conv(F.rpad(F.substring(digits, 1, 4), 4, "0"), 2, 10).cast("int")


def source_targets(sizes: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in code-point order, null last, weigh cycle[0], cycle[1], ... repeating. All
    sizes together are shared by weight; a target stops at cap * source_size and what is
    over goes to the others by weight, until none is above. That end state is a common level
    per weight: the sources with the least cap * size / weight are capped, as many as needed.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, cycle)), ((F.row_number().over(by_name) - 1) % len(cycle) + 1).cast("int")).cast("long")
    weighed = sizes.withColumn("weight", weight).withColumn("limit", F.col("source_size") * cap)
    by_level = Window.orderBy((F.col("limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    upto = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy()
    levelled = weighed.withColumn("capped", F.coalesce(F.sum("limit").over(upto), F.lit(0))).withColumn("spent", F.coalesce(F.sum("weight").over(upto), F.lit(0)))
    levelled = levelled.withColumn("level", (F.sum("source_size").over(everyone) - F.col("capped")) / (F.sum("weight").over(everyone) - F.col("spent")))
    # The first source, by level, whose own cap is not below the level of those from it on.
    fits = F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level"))
    levelled = levelled.withColumn("common", F.first(fits, ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("limit").cast("double"), F.coalesce(F.col("common") * F.col("weight"), F.col("limit").cast("double")))
    return levelled.select("source", "source_size", target.alias("target"))


def mix_sources(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, cap: int = 3, row_col: str | None = None) -> DataFrame:
    """(id, size, source_size, target, copies, taken) for every row of documents.

    size is the number of words, 0 for null and empty texts; taken = copies * size. Null
    sources are one source; ids may be null or repeated: rows of one source that agree in
    size and id are interchangeable. An empty table gives no rows. Extra columns are ignored.
    The offset depends on seed and source alone, so reruns agree. row_col names a column that
    tells rows of one id apart; it is returned too and breaks ties of size and id.
    """
    key = [] if row_col is None else [row_col]
    rows = documents.select(*key, F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), count_words(F.col(text_col)).alias("size"))
    rows = materialize(rows.withColumn("class", size_class("size")), "sizes")
    targets = materialize(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), cap=cap), "targets")
    numbered = number_within(rows, ["source"], ["class"], ["size", "id", *key], hashed(F.col("id"), str(seed)), "at").alias("l")
    joined = numbered.join(targets.alias("r"), F.col("l.source").eqNullSafe(F.col("r.source"))).select("l.*", "source_size", "target")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = F.pmod(hashed(F.coalesce(F.col("source"), F.lit("\0null")), f"{seed}:"), F.lit(_STEPS)) / _STEPS
    crossed = F.floor(each * F.col("at") + offset) - F.floor(each * (F.col("at") - 1) + offset)
    copies = F.least(crossed, F.lit(cap)).cast("long")
    out = joined.withColumn("copies", copies)
    return out.select(*key, F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
