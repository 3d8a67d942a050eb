"""Naming, audit, votes and sessions of stacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom.operators import review as R
from stackloom.sources import adapter as A
from stackloom.streaming import ingest as stream

_TAGS = {1: "PatientName_0010_0010", 2: "PatientID_0010_0020", 3: "StudyDate_0008_0020", 4: "StationName_0008_1010"}


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def export_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that collide within a study and folder are numbered."""
    rows = A.instances(spark, sf_dir).select("sop_uid", "study_id", F.col("image_type").alias("folder"), F.concat_ws("-", "coil", "echo_numbers").alias("name"), "acquisition_date")
    order = [F.coalesce(F.col("acquisition_date").cast("string"), F.lit("zzz")), F.col("sop_uid")]
    return R.unique_names(rows, ["study_id", "folder"], "name", order).select("sop_uid", "study_id", "folder", "unique_name")


def export_file_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of each series in order of their instance numbers."""
    row = F.struct(F.col("instance_number").isNull().alias("last"), "instance_number", "sop_uid")
    files = A.instances(spark, sf_dir).groupBy("series_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return files.select("series_id", F.array_join(F.transform("rows", lambda x: x["sop_uid"]), ",").alias("files"))


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("study_id"), (F.col("l_partkey") % 4 + 1).alias("tag"), F.concat_ws("-", F.format_string("%06d", "l_suppkey"), "l_linenumber").alias("at"), F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag")).alias("old"), F.when(F.col("l_linestatus") != "O", F.col("l_linestatus")).alias("new"))
    return R.merge_audit(rows, ["study_id", "tag"], "at", "old", "new")


def audit_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First old and last new value of each study's tags."""
    return _audit(spark, sf_dir)


def audit_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A study's audit as one row."""
    return R.pivot_audit(_audit(spark, sf_dir), "study_id", "tag", _TAGS)


def contrast_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of two and more stacks that all have the same contrast value."""
    rows = A.instances(spark, sf_dir).withColumn("post", (F.col("te") > 25).cast("int"))
    grouped = rows.groupBy("study_id", "image_type").agg(F.count("*").alias("n"), F.min("post").alias("post"), F.max("post").alias("top"))
    return grouped.filter("n >= 2 and post = top").drop("top")


def technique_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most common pair of each study."""
    return R.majority_pair(A.instances(spark, sf_dir), "study_id", ["image_type", "coil"])


def evidence_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence from weighted evidence of several kinds."""
    found = R.evidence_confidence(A.instances(spark, sf_dir).withColumn("weight", F.col("fa") / 110), "study_id", "image_type", "weight")
    return found.withColumn("confidence", F.round("confidence", 6))


def recovered_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A study's date from ranked sources."""
    return R.recovered_date(A.instances(spark, sf_dir), "study_id", [F.when(F.col("te") > 40, F.col("acquisition_date")), F.date_add("acquisition_date", 1)])


def construct_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a study's set meets one set and holds another."""
    sets = A.instances(spark, sf_dir).groupBy("study_id").agg(F.collect_set("image_type").alias("s"))
    both = F.array(F.lit("A"), F.lit("R"))
    return sets.select("study_id", F.arrays_overlap("s", both).alias("meets"), (F.size(F.array_intersect("s", both)) == 2).alias("holds"))


def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of each session by state (A20, A21), and the newest item."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    state = F.col("o_orderstatus")
    return orders.groupBy(F.col("o_custkey").alias("session_id")).agg(
        F.count("*").alias("total"), F.count_if(state.isin("O", "F")).alias("reviewed"), F.count_if(state == "F").alias("confirmed"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("newest")
    )


def operation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, total, least, most and mean of each operation."""
    value = F.col("value")
    stats = [F.count(value).alias("n"), F.round(F.sum(value), 4).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"), F.round(F.avg(value), 6).alias("mean")]
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").agg(*stats)


def missing_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects that have no dated study in 1998 (U4)."""
    recent = A.studies(spark, sf_dir).filter("study_date >= DATE '1998-01-01'")
    return A.subjects(spark, sf_dir).join(recent, "subject_id", "left_anti").select("subject_id", "subject_code")


def streamed_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header rows read as a stream, each SOP key once."""
    return stream.ingest_once(spark, f"{sf_dir}/lineitem*.parquet", lambda rows: rows.selectExpr("concat_ws('.', l_orderkey, l_linenumber) AS sop_uid", "l_orderkey AS study_id"), ["sop_uid"])


_ALL = (export_names, export_file_lists, audit_merge, audit_pivot, contrast_conflicts, technique_vote, evidence_confidence, recovered_dates, construct_sets, session_counts, operation_stats, missing_members, streamed_headers)
QUERIES = {f.__name__: f for f in _ALL}


_AUDIT = """audit AS (SELECT l_orderkey AS study_id, l_partkey % 4 + 1 AS tag, printf('%06d', l_suppkey) || '-' || l_linenumber AS at_,
    CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS o, CASE WHEN l_linestatus <> 'O' THEN l_linestatus END AS n FROM lineitem),
merged AS (SELECT study_id, tag, min((at_, o)) FILTER (o IS NOT NULL) AS a, max((at_, n)) FILTER (n IS NOT NULL) AS b FROM audit GROUP BY study_id, tag),
m AS (SELECT study_id, tag, a[2] AS old_value, b[2] AS new_value FROM merged)"""

ORACLE_SQL = {
    "export_names": f"""WITH {A.CTES}, n AS (SELECT sop_uid, study_id, image_type AS folder, concat_ws('-', coil, echo_numbers) AS name, coalesce(CAST(acquisition_date AS VARCHAR), 'zzz') AS d FROM instance)
SELECT sop_uid, study_id, folder, CASE WHEN count(*) OVER (PARTITION BY study_id, folder, name) > 1
    THEN name || '_' || row_number() OVER (PARTITION BY study_id, folder, name ORDER BY d, sop_uid) ELSE name END AS unique_name FROM n""",
    "export_file_lists": f"WITH {A.CTES} SELECT series_id, string_agg(sop_uid, ',' ORDER BY instance_number NULLS LAST, sop_uid) AS files FROM instance GROUP BY series_id",
    "audit_merge": f"WITH {_AUDIT} SELECT * FROM m",
    "audit_pivot": f"WITH {_AUDIT} SELECT study_id, " + ", ".join(f"max({side}) FILTER (tag = {t}) AS {n}_{side}" for t, n in _TAGS.items() for side in ("old_value", "new_value")) + " FROM m GROUP BY study_id",
    "contrast_conflicts": f"WITH {A.CTES} SELECT study_id, image_type, count(*) AS n, min(CAST(te > 25 AS INTEGER)) AS post FROM instance GROUP BY ALL HAVING count(*) >= 2 AND min(te > 25) = max(te > 25)",
    "technique_vote": f"""WITH {A.CTES}, c AS (SELECT study_id, image_type, coil, count(*) AS votes FROM instance WHERE image_type IS NOT NULL AND coil IS NOT NULL GROUP BY ALL HAVING count(*) >= 2)
SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY study_id ORDER BY votes DESC, image_type, coil) = 1""",
    "evidence_confidence": f"WITH {A.CTES} SELECT study_id, round(least(0.99::DOUBLE, max(fa / 110) + 0.05::DOUBLE * (count(DISTINCT image_type) - 1)), 6) AS confidence FROM instance GROUP BY study_id",
    "recovered_dates": f"""WITH {A.CTES}, r AS (SELECT study_id, 0 AS source_rank, acquisition_date AS d FROM instance WHERE te > 40 AND acquisition_date IS NOT NULL
    UNION ALL SELECT study_id, 1, acquisition_date + 1 FROM instance WHERE acquisition_date IS NOT NULL)
SELECT study_id, d AS recovered, source_rank FROM r QUALIFY row_number() OVER (PARTITION BY study_id ORDER BY source_rank, d) = 1""",
    "construct_sets": f"WITH {A.CTES} SELECT study_id, bool_or(image_type IN ('A', 'R')) AS meets, bool_or(image_type = 'A') AND bool_or(image_type = 'R') AS holds FROM instance GROUP BY study_id",
    "session_counts": """SELECT o_custkey AS session_id, count(*) AS total, count(*) FILTER (o_orderstatus IN ('O', 'F')) AS reviewed, count(*) FILTER (o_orderstatus = 'F') AS confirmed,
    first(o_orderkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS newest FROM orders GROUP BY o_custkey""",
    "operation_stats": "SELECT event_type, count(value) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean FROM events GROUP BY event_type",
    "missing_members": f"WITH {A.CTES} SELECT subject_id, subject_code FROM subject WHERE subject_id NOT IN (SELECT subject_id FROM study WHERE study_date >= DATE '1998-01-01')",
    "streamed_headers": "SELECT DISTINCT concat_ws('.', l_orderkey, l_linenumber) AS sop_uid, l_orderkey AS study_id FROM lineitem",
}
