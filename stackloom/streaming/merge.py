"""Streaming ingest into tables of instances, series, studies and subjects, with a duplicate policy.

Every micro-batch becomes one folder `batch=<id>` of each table, written with overwrite: a batch that
runs again after a crash replaces what it had written and sees only the batches before it, so
each batch counts once. Parents come from accepted instances alone, so that none is an orphan.
What a parent is linked to is kept as smallest and largest values, which add up in any order: a
batch writes one row for each parent it touches, current rows are an aggregate over batches, and
compacted gives what one batch would have written. No state is held outside of these tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.storagelevel import StorageLevel

from stackloom.streaming.ingest import _shared

#: Keys of a batch are sent to the tasks that scan known instances up to this many bytes.
SENT_BYTES, KEY_BYTES = 32 << 20, 96
SKIP, OVERWRITE, APPEND_SERIES = "skip", "overwrite", "append_series"
# What conflicts say, by scope.
MESSAGES = {
    "subject_identifier": "Conflicting patient identifier for subject",
    "study": "Study assigned to a different subject; re-linking based on DICOM tags",
    "series": "Series metadata linked to a different subject/study; re-linking",
    "instance": "Duplicate SOP Instance",
}
#: Scope -> its uid, and what a row of that uid is linked to.
LINKS = {"subject_identifier": ("subject_code", ("patient_id",)), "study": ("study_uid", ("subject_code",)), "series": ("series_uid", ("study_uid", "subject_code"))}


@dataclass(frozen=True)
class Merge:
    """Where the tables lie and how duplicates are treated.

    skip and append_series keep the first row of a SOP UID by `order` and log the others as
    conflicts (but for rows of the very same file in one batch); overwrite keeps the last, and
    rows that are replaced later leave their parents behind. order
    is a column that grows from batch to batch.
    """

    root: str
    policy: str = SKIP
    order: str = "arrival"

    def read(self, spark: SparkSession, table: str, before: int | None = None) -> DataFrame | None:
        """The rows of all batches, or of those before one; None if there are none."""
        try:
            rows = spark.read.option("basePath", f"{self.root}/{table}").parquet(f"{self.root}/{table}")
        except AnalysisException:
            return None
        return rows if before is None else rows.filter(F.col("batch") < before)

    def _write(self, rows: DataFrame, table: str, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/{table}/batch={batch}")

    def told(self, rows: DataFrame, batch: int) -> DataFrame:
        """The batch's rows with __i, the row's place within its SOP UID, from 1; unless the policy is
        overwrite also with __at and __path, order and file_path of the first, and __known, true if an earlier
        batch has the SOP UID, else null. Rows are shuffled and sorted once for all of it."""
        whole = [F.col(c) for c in (self.order, "file_path", *(c for c in rows.columns if c not in ("sop_uid", self.order, "file_path")))]
        by = Window.partitionBy("sop_uid").orderBy(*([c.desc() for c in whole] if self.policy == OVERWRITE else whole))
        if self.policy == OVERWRITE:
            return rows.repartition("sop_uid").withColumn("__i", F.row_number().over(by))
        placed = rows.withColumns({"__i": F.row_number().over(by), "__at": F.first(self.order).over(by), "__path": F.first("file_path").over(by)})
        known = self.read(rows.sparkSession, "instances", batch)
        if known is None:
            return placed.withColumn("__known", F.lit(None).cast("boolean"))
        known = known.select("sop_uid")
        if rows.count() * KEY_BYTES <= SENT_BYTES:
            # The large table is scanned for the batch's keys, which are few; it is not shuffled for them.
            known = known.join(F.broadcast(rows.select("sop_uid").distinct()), "sop_uid", "left_semi")
        return placed.join(known.withColumn("__known", F.lit(True)), "sop_uid", "left")

    def apply(self, rows: DataFrame, batch: int) -> None:
        """Merge one batch: rows(sop_uid, series_uid, study_uid, subject_code, patient_id, file_path, order, ...)."""
        spark = rows.sparkSession
        rows = rows.filter("sop_uid is not null")
        told = self.told(rows, batch)
        if self.policy == OVERWRITE:
            self._write(told.filter("__i = 1").select(*rows.columns), "instances", batch)
            self._link(spark, rows.schema, batch)
            return
        told = told.persist(StorageLevel.DISK_ONLY)  # two tables are written from it
        try:
            self._write(told.filter("__i = 1 and __known is null").select(*rows.columns), "instances", batch)
            self._link(spark, rows.schema, batch)
            # Of a new SOP UID the first row is no duplicate; of a known one all rows are.
            rejected = told.filter(F.col("__known").isNotNull() | (F.col(self.order) != F.col("__at")) | ~F.col("file_path").eqNullSafe(F.col("__path")))
            first = rejected.groupBy(F.col("sop_uid").alias("uid")).agg(F.min(F.struct(self.order, "file_path")).alias("at"))
            self._write(first, "duplicates", batch)
        finally:
            told.unpersist()

    def _link(self, spark: SparkSession, schema: StructType, batch: int) -> None:
        """What the accepted instances of a batch say of their parents."""
        accepted = spark.read.schema(schema).parquet(f"{self.root}/instances/batch={batch}")
        for scope, (uid, link) in LINKS.items():
            at, link = F.struct(self.order, "file_path"), F.struct(*link)
            first, last, low, high = _extremes(at, link)
            # The structs are built when rows are aggregated: what is sorted has each column once.
            held = accepted.filter(F.col(uid).isNotNull()).groupBy(F.col(uid).alias("uid"))
            self._write(held.agg(F.min(first).alias("first"), F.max(last).alias("last"), F.min(low).alias("low"), F.max(high).alias("high")), scope, batch)

    def parents(self, spark: SparkSession, scope: str) -> DataFrame:
        """(uid, the columns linked to, conflict, first_path) of a scope: the last link by order, and
        whether other links came before."""
        rows = _folded(self.read(spark, scope).drop("batch"))
        return rows.select("uid", "last.link.*", (F.col("low") != F.col("high")).alias("conflict"), F.col("first.at.file_path").alias("first_path"))

    def instances(self, spark: SparkSession) -> DataFrame:
        """The instances as they stand."""
        rows = self.read(spark, "instances")
        if self.policy != OVERWRITE:
            return rows.drop("batch")
        columns = [c for c in rows.columns if c not in ("sop_uid", "batch")]
        return rows.groupBy("sop_uid").agg(F.max(F.struct("batch", *columns)).alias("r")).select("sop_uid", *(f"r.{c}" for c in columns))

    def conflicts(self, spark: SparkSession) -> DataFrame:
        """(scope, uid, message, file_path): one row for each uid in conflict; file_path is that of the
        first duplicate, or of the last row that was linked otherwise."""
        out = []
        for scope in LINKS:
            rows = _folded(self.read(spark, scope).drop("batch")).filter("low != high")
            out.append(rows.select(F.lit(scope).alias("scope"), "uid", F.lit(MESSAGES[scope]).alias("message"), F.col("last.at.file_path").alias("file_path")))
        found = self.read(spark, "duplicates")
        if found is not None:
            out.append(found.groupBy("uid").agg(F.min("at").alias("at")).select(F.lit("instance").alias("scope"), "uid", F.lit(MESSAGES["instance"]).alias("message"), "at.file_path"))
        result = out[0]
        for part in out[1:]:
            result = result.union(part)
        return result

    def compacted(self, spark: SparkSession, scope: str) -> DataFrame:
        """All batches of a scope as the rows that one batch would have written."""
        return _folded(self.read(spark, scope).drop("batch"))


def _extremes(at, link) -> list:
    """What a row says of its parent: the first and last link, and the smallest and largest."""
    return [F.struct(at.alias("at"), link.alias("link")).alias("first"), F.struct(at.alias("at"), link.alias("link")).alias("last"), link.alias("low"), link.alias("high")]


def _folded(rows: DataFrame) -> DataFrame:
    """One row for each uid; folding folded rows again gives the same. A batch has one row for a uid, so
    nothing is gained by folding before the shuffle."""
    return rows.repartition("uid").groupBy("uid").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min("low").alias("low"), F.max("high").alias("high"))


def merge_stream(spark: SparkSession, files: str, shape: Callable[[DataFrame], DataFrame], name: str, policy: str = SKIP, order: str = "arrival", files_per_batch: int | None = None) -> Merge:
    """Read the files that are there and not read yet as a stream, and merge each micro-batch.

    Calls of one name go on where the last one ended, also after a failure in the middle of a
    batch. At most files_per_batch files make a batch. Returns the tables.
    """
    root = _shared(spark, name)
    merge = Merge(f"{root}/tables", policy, order)
    source = spark.readStream.schema(spark.read.parquet(files).schema)
    source = source.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else source
    query = shape(source.parquet(files)).writeStream.foreachBatch(lambda rows, batch: merge.apply(rows, batch)).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return merge
