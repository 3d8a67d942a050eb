"""Incremental ingest: header files read as a stream, each key kept once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _shared(spark: SparkSession, name: str | None) -> str:
    """A new folder below spark.checkpoint.dir; a local master may go without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="stackloom-")
    return f"{base.rstrip('/')}/stream-{name or uuid.uuid4().hex[:12]}"


def ingest_once(spark: SparkSession, files: str, shape: Callable[[DataFrame], DataFrame], keys: list[str], event_time: str | None = None, delay: str = "1 day", name: str | None = None) -> DataFrame:
    """Reads all files that are there as a stream, drops rows whose key came before, appends
    the others as Parquet and returns them. Calls of one name go on where the last one ended:
    files that it read are not read again, and keys that it saw stay seen. Without a name a call
    stands alone.

    With event_time the state of a key is dropped after `delay`; without, every key is kept
    in the state store, which grows with the keys. The sink and the state restart from the
    checkpoint after a loss.
    """
    at = _shared(spark, name)
    rows = shape(spark.readStream.schema(spark.read.parquet(files).schema).parquet(files))
    once = rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys) if event_time else rows.dropDuplicates(keys)
    query = once.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(once.schema).parquet(f"{at}/rows")
