"""A stream of header rows merged in batches, with a stop in between."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom.streaming.ingest import _shared
from stackloom.streaming.merge import OVERWRITE, SKIP, Merge, merge_stream

#: Lines of an order, as they arrive in three deliveries.
_DELIVERIES = ("l_linenumber <= 2", "l_linenumber between 3 and 4", "l_linenumber > 4")
#: A delivery has this many files, more if a file would have more than about so many rows.
_FILES, _FILE_ROWS = 4, 1_000_000
_ROWS = (
    "concat_ws('.', l_orderkey, l_partkey % 4) AS sop_uid", "concat_ws('.', l_orderkey, l_partkey % 2) AS series_uid", "CAST(l_orderkey div 2 AS STRING) AS study_uid",
    "concat('S', CASE WHEN l_linenumber >= 4 AND l_suppkey % 7 = 0 THEN l_orderkey % 50 + 100 ELSE l_orderkey div 2 % 50 END) AS subject_code", "concat('P', CASE WHEN l_partkey % 997 = 0 THEN 1 ELSE 0 END) AS patient_id",
    "concat_ws('/', 'in', l_orderkey, l_linenumber) AS file_path", "CAST(l_linenumber AS BIGINT) * 1000000000 + l_orderkey AS arrival", "l_quantity AS te",
)


def _merged(spark: SparkSession, sf_dir: str, policy: str) -> Merge:
    """Three deliveries: two are merged, then the stream stops and goes on with the third."""
    name, lines = f"merge-{uuid.uuid4().hex[:12]}", spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    files = max(_FILES, -(-lines.count() // (len(_DELIVERIES) * _FILE_ROWS)))
    folder = _shared(spark, f"{name}-in")
    for i, part in enumerate(_DELIVERIES):
        lines.filter(part).repartition(files, "l_orderkey").write.mode("append").parquet(folder)
        if i:
            merge = merge_stream(spark, folder, lambda rows: rows.selectExpr(*_ROWS), name, policy, files_per_batch=files)
    return merge


def streamed_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances that a stream accepts, the first of each SOP UID, with the parents' links as they
    stand at the end (K6, K4, T2)."""
    merge = _merged(spark, sf_dir, SKIP)
    studies = merge.parents(spark, "study").select(F.col("uid").alias("study_uid"), F.col("subject_code").alias("linked_subject"), F.col("conflict").alias("study_conflict"))
    return merge.instances(spark).select("sop_uid", "study_uid", "file_path", "te").join(studies, "study_uid")


def streamed_merge_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same stream where the last row of a SOP UID counts (K6)."""
    return _merged(spark, sf_dir, OVERWRITE).instances(spark).select("sop_uid", "study_uid", "file_path", "te")


def ingest_conflict_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflicts of all four scopes that the stream has met (K9)."""
    return _merged(spark, sf_dir, SKIP).conflicts(spark).select("scope", "uid", "message")


QUERIES = {f.__name__: f for f in (streamed_merge, streamed_merge_overwrite, ingest_conflict_log)}

_SQL = """WITH r AS (SELECT concat_ws('.', l_orderkey, l_partkey % 4) AS sop_uid, concat_ws('.', l_orderkey, l_partkey % 2) AS series_uid, CAST(l_orderkey // 2 AS VARCHAR) AS study_uid,
    'S' || CASE WHEN l_linenumber >= 4 AND l_suppkey % 7 = 0 THEN l_orderkey % 50 + 100 ELSE l_orderkey // 2 % 50 END AS subject_code, 'P' || CASE WHEN l_partkey % 997 = 0 THEN 1 ELSE 0 END AS patient_id,
    concat_ws('/', 'in', l_orderkey, l_linenumber) AS file_path, CAST(l_linenumber AS BIGINT) * 1000000000 + l_orderkey AS arrival, l_quantity AS te, row_number() OVER () AS n FROM lineitem),
f AS (SELECT *, row_number() OVER (PARTITION BY sop_uid ORDER BY arrival, file_path, series_uid, study_uid, subject_code, patient_id, te) AS i, count(*) OVER (PARTITION BY sop_uid) AS copies FROM r),
a AS (SELECT * FROM f WHERE i = 1)"""

ORACLE_SQL = {
    "streamed_merge": f"""{_SQL}, s AS (SELECT study_uid, arg_max(subject_code, (arrival, file_path, subject_code)) AS linked_subject, count(DISTINCT subject_code) > 1 AS study_conflict FROM a GROUP BY 1)
SELECT sop_uid, study_uid, file_path, te, linked_subject, study_conflict FROM a JOIN s USING (study_uid)""",
    "streamed_merge_overwrite": f"{_SQL} SELECT sop_uid, study_uid, file_path, te FROM f WHERE i = copies",
    "ingest_conflict_log": f"""{_SQL} SELECT 'instance' AS scope, sop_uid AS uid, 'Duplicate SOP Instance' AS message FROM f GROUP BY sop_uid HAVING count(DISTINCT (arrival, file_path)) > 1 -- a file listed twice is no duplicate
UNION ALL SELECT 'study', study_uid, 'Study assigned to a different subject; re-linking based on DICOM tags' FROM a GROUP BY study_uid HAVING count(DISTINCT subject_code) > 1
UNION ALL SELECT 'series', series_uid, 'Series metadata linked to a different subject/study; re-linking' FROM a GROUP BY series_uid HAVING count(DISTINCT (study_uid, subject_code)) > 1
UNION ALL SELECT 'subject_identifier', subject_code, 'Conflicting patient identifier for subject' FROM a GROUP BY subject_code HAVING count(DISTINCT patient_id) > 1""",
}
