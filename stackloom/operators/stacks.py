"""Stacks: homogeneous groups of a series' instances, with indices that later runs keep."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The fields of a stack's signature beside its series, and the decimals that numbers are rounded to
# (None: as they are).
SIGNATURE = {
    "echo_time": 2,
    "inversion_time": 1,
    "echo_numbers": None,
    "echo_train_length": None,
    "repetition_time": 1,
    "flip_angle": 1,
    "receive_coil_name": None,
    "xray_exposure": None,
    "kvp": 0,
    "tube_current": 0,
    "pet_bed_index": None,
    "pet_frame_type": None,
    "orientation": None,
    "image_type": None,
}
# The fields that explain why a series has several stacks, and what each calls it, first match first.
EXPLAINING = ("echo_time", "echo_numbers", "inversion_time", "repetition_time", "flip_angle", "receive_coil_name", "orientation", "image_type", "xray_exposure", "kvp", "tube_current", "pet_bed_index", "pet_frame_type")
STACK_KEYS = {
    "echo_time": "multi_echo",
    "echo_numbers": "multi_echo",
    "image_type": "image_type_variation",
    "orientation": "multi_orientation",
    "pet_bed_index": "multi_bed",
    "inversion_time": "multi_ti",
    "flip_angle": "multi_flip_angle",
    "receive_coil_name": "multi_coil",
}
SEVERAL, OTHER = "multi_parameter", "multi_stack"


def signature(columns: dict[str, int | None] = SIGNATURE) -> list[Column]:
    return [(F.bround(c, d) if d is not None else F.col(c)).alias(c) for c, d in columns.items()]


def ensure_stacks(instances: DataFrame, known: DataFrame | None = None, columns: dict[str, int | None] = SIGNATURE, series: str = "series_id", order: str = "sop_uid") -> DataFrame:
    """One row for each (series, signature) that is known or comes with the instances: its
    stack_index within the series, n_instances that came, the first of them by `order`, and
    whether it is new.

    known(series, signature, stack_index) are the stacks of earlier runs, as they were stored:
    they keep their index, and new ones follow the largest of their series, by their first
    instance. Nulls of a signature column are one value. Of a signature stored twice the
    smaller index counts. Known and new rows meet in one aggregate by series and signature, so
    the only rows numbered by series are its distinct signatures.
    """
    came = instances.select(series, *signature(columns), F.col(order).alias("first_instance"), F.lit(1).cast("long").alias("n"), F.lit(None).cast("int").alias("stored"))
    if known is not None:
        came = came.unionByName(known.select(series, *columns, F.lit(None).cast(instances.schema[order].dataType).alias("first_instance"), F.lit(0).cast("long").alias("n"), F.col("stack_index").cast("int").alias("stored")))
    stacks = came.groupBy(series, *columns).agg(F.min("stored").alias("stored"), F.min("first_instance").alias("first_instance"), F.sum("n").alias("n_instances"))
    whole = Window.partitionBy(series)
    by_first = whole.orderBy(F.col("stored").asc_nulls_last(), "first_instance", *(F.col(c).asc_nulls_first() for c in columns))
    following = F.coalesce(F.max("stored").over(whole), F.lit(-1)) + F.row_number().over(by_first) - F.count("stored").over(whole)
    return stacks.select(series, *columns, "first_instance", "n_instances", F.coalesce("stored", following).cast("int").alias("stack_index"), F.col("stored").isNull().alias("is_new"))


def stack_of_instances(instances: DataFrame, stacks: DataFrame, columns: dict[str, int | None] = SIGNATURE, series: str = "series_id") -> DataFrame:
    """The instances with the stack_index of the stack whose signature they have."""
    keyed = instances.withColumns({f"__{c}": F.bround(c, d) if d is not None else F.col(c) for c, d in columns.items()}).alias("i")
    same = reduce(lambda a, b: a & b, (F.col(f"i.__{c}").eqNullSafe(F.col(f"s.{c}")) for c in columns), F.col(f"i.{series}") == F.col(f"s.{series}"))
    return keyed.join(stacks.alias("s"), same).select(*(f"i.{c}" for c in instances.columns), "s.stack_index")


def varying_columns(stacks: DataFrame, columns: list[str]) -> DataFrame:
    """(series_id, n_stacks, varies_<column>...): a null is a value of its own. Extremes and counts
    tell it in one pass, where distinct counts would repeat every row for each column."""
    differs = lambda c: F.coalesce(F.min(c) != F.max(c), F.lit(False))
    distinct = [(differs(c) | ((F.count(c) > 0) & (F.count(c) < F.count("*")))).alias(f"varies_{c}") for c in columns]
    return stacks.groupBy("series_id").agg(F.count("*").alias("n_stacks"), *distinct)


def stack_key(stacks: DataFrame, explaining: tuple[str, ...] = EXPLAINING) -> DataFrame:
    """(series_id, n_stacks, stack_key): null for one stack, the name of the first varying column
    of STACK_KEYS, else whether several columns vary."""
    found = varying_columns(stacks, list(explaining))
    number = sum((F.col(f"varies_{c}").cast("int") for c in explaining), F.lit(0))
    key = F.coalesce(*(F.when(F.col(f"varies_{c}"), k) for c, k in STACK_KEYS.items() if c in explaining), F.when(number > 1, SEVERAL), F.lit(OTHER))
    return found.select("series_id", "n_stacks", F.when(F.col("n_stacks") > 1, key).alias("stack_key"))
