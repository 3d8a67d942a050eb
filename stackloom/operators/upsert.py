"""Writes of a table without a transactional format: new rows and old rows become the next table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def same(left: str, right: str, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new replace rows of old with the same keys; the others are added. Keys must be
    unique in new. Columns that only one side has are null on the other."""
    kept = old.alias("o").join(new.select(*keys).alias("n"), same("o", "n", keys), "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def merge_non_null(old: DataFrame, new: DataFrame, keys: list[str], skip_blank: bool = True) -> DataFrame:
    """As upsert, but with skip_blank a null in new keeps what old has."""
    values = [c for c in old.columns if c not in keys]
    joined = old.alias("o").join(new.alias("n"), same("o", "n", keys), "full_outer").withColumn("__is_new", F.coalesce(*(F.col(f"n.{k}").isNotNull() for k in keys[:1])))
    key_columns = [F.coalesce(F.col(f"n.{k}"), F.col(f"o.{k}")).alias(k) for k in keys]
    pick = (lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))) if skip_blank else (lambda c: F.when(F.col("__is_new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")))
    return joined.select(*key_columns, *(pick(c).alias(c) for c in values))


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows, and rows of new whose keys old lacks."""
    return old.unionByName(new.alias("n").join(old.select(*keys).alias("o"), same("n", "o", keys), "left_anti"), allowMissingColumns=True)


def first_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; ties are settled by the order given."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__first", F.row_number().over(by)).filter("__first = 1").drop("__first")


def delete_where_in(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.alias("r").join(gone.select(*keys).alias("g"), same("r", "g", keys), "left_anti")


def assign_ids(old: DataFrame, new_keys: DataFrame, key: str, id_col: str) -> DataFrame:
    """(key, id): known keys keep their ids, new ones get the numbers after the largest, by
    key. New keys are numbered within hash ranges whose sizes are summed first, so no task
    sorts them all."""
    fresh = new_keys.select(key).dropna().distinct().join(old.select(key), key, "left_anti")
    fresh = fresh.withColumn("__range", F.pmod(F.xxhash64(key), F.lit(256)))
    sizes = fresh.groupBy("__range").agg(F.count("*").alias("__n"))
    starts = sizes.withColumn("__start", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    own = F.row_number().over(Window.partitionBy("__range").orderBy(key))
    top = old.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("__top"))
    numbered = fresh.withColumn("__own", own).join(F.broadcast(starts), "__range").join(F.broadcast(top))
    return old.select(key, id_col).unionByName(numbered.select(key, (F.col("__top") + F.col("__start") + F.col("__own")).cast("long").alias(id_col)))
