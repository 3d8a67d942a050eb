"""The table explorer: search, order and page any table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def explore(rows: DataFrame, search: str = "", order: list[tuple[str, bool]] = (), start: int = 0, length: int = 25) -> DataFrame:
    """A page of the rows that hold `search` in any text column, in any case, with the counts
    of all and of found rows. order: (column, ascending), nulls last; length is held in 1..500."""
    texts = [f.name for f in rows.schema if f.dataType.simpleString() == "string"]
    found = rows
    if search and texts:
        found = rows.filter(reduce(lambda a, b: a | b, (F.lower(c).contains(search.lower()) for c in texts)))
    keys = [F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in order]
    page = (found.orderBy(*keys) if keys else found).offset(start).limit(max(1, min(500, length)))
    counts = rows.agg(F.count("*").alias("total_rows")).join(F.broadcast(found.agg(F.count("*").alias("filtered_rows"))))
    return page.join(F.broadcast(counts))


def found_subjects(subjects: DataFrame, identifiers: DataFrame, search: str = "") -> DataFrame:
    """subjects(subject_id, subject_code, ...) whose code, id or any of whose other
    identifiers(subject_id, value) holds `search`, in any case; % and _ in it stand for any text and
    any one character. Each subject comes once; an empty search finds all."""
    if not search:
        return subjects
    like = f"%{search}%"
    named = identifiers.filter(F.ilike("value", F.lit(like))).select("subject_id").distinct().withColumn("__named", F.lit(True))
    rows = subjects.join(named, "subject_id", "left")
    own = F.ilike(F.coalesce("subject_code", F.lit("")), F.lit(like)) | F.ilike(F.col("subject_id").cast("string"), F.lit(like))
    return rows.filter(F.coalesce(own, F.lit(False)) | F.col("__named").isNotNull()).select(*subjects.columns)
