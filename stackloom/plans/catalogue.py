"""The registered queries: name -> (spark, sf_dir) -> DataFrame, and DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stackloom.plans import archive, cases, classification, cohort, completing, features, fingerprints, handling, importing, ingest, merging, readings, resuming, review, wording

_MODULES = (cohort, archive, ingest, features, fingerprints, cases, classification, completing, handling, importing, merging, readings, resuming, review, wording)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _module in _MODULES:
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
