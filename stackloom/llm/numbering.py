"""Row numbers within hot groups without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackloom.llm.tables import broadcast_if_small, materialize

#: Rows that one task numbers, about.
RUN_ROWS = 20_000


def hashed(column: Column, salt: str = "") -> Column:
    """28 bits of md5 of a value's text: the same number in Spark and in other engines."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.coalesce(column.cast("string"), F.lit("")))), 1, 7), 16, 10).cast("long")


def number_within(df: DataFrame, group: list[str], strata: list[str], order: list[str], spread: Column, out: str) -> DataFrame:
    """Adds `out`, 1, 2, 3, ... within each group, in the order of strata, runs and `order`.

    Each (group, strata) is cut into runs of about RUN_ROWS rows by `spread`, an evenly
    spread number. A run is numbered alone, and starts after the rows of the runs before it:
    their counts are summed in a window over runs, not rows. Null groups are groups.
    """
    keys = [*group, *strata]
    rows = materialize(df.withColumn("__spread", spread), "to-number")
    match = lambda names: [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in names]
    runs = materialize(rows.groupBy(*keys).agg(F.ceil(F.count("*") / RUN_ROWS).cast("long").alias("__runs")), "runs")
    rows = rows.alias("l").join(broadcast_if_small(runs, 64).alias("r"), match(keys)).select("l.*", "__runs").withColumn("__run", F.pmod(F.col("__spread"), F.col("__runs")))
    counts = rows.groupBy(*keys, "__run").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*group).orderBy(*strata, "__run").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    own = F.row_number().over(Window.partitionBy(*keys, "__run").orderBy(*order))
    joined = rows.withColumn("__own", own).alias("l").join(starts.alias("r"), match([*keys, "__run"]))
    return joined.select(*(f"l.{c}" for c in df.columns), (F.col("__own") + F.col("__start")).alias(out))
