"""Sets kept as comma-separated text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_list(c: Column) -> Column:
    """Trimmed, non-empty parts; null gives an empty list."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def to_csv(array: Column) -> Column:
    """Sorted distinct parts joined by commas."""
    return F.array_join(F.array_sort(F.array_distinct(array)), ",")


def add(c: Column, *reasons: Column | str) -> Column:
    return to_csv(F.array_union(to_list(c), F.array(*(r if isinstance(r, Column) else F.lit(r) for r in reasons))))


def remove(c: Column, reason: Column | str) -> Column:
    return to_csv(F.array_remove(to_list(c), reason))
