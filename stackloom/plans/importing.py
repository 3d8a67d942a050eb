"""Imports of instances, cohorts, subject codes and identifier types; small readings of names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom.functions import dicom as D
from stackloom.functions import text as T
from stackloom.operators import imports as M


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _instances(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Instances, and rows of a file about some of them, texts as exports write them."""
    k = F.col("o_orderkey")
    instances = _table(spark, sf_dir, "orders").select(k.alias("instance_id"), F.lit("OLD").alias("image_type"), F.lit(1.0).alias("echo_time"), F.lit(5).cast("long").alias("echo_train_length"), F.lit("path").alias("file_path"))
    rows = _table(spark, sf_dir, "orders").filter("o_orderkey % 3 <> 0").select(
        F.when(k % 50 == 1, " ").otherwise(F.concat(F.lit(" "), k.cast("string"))).alias(" Instance_ID "), F.when(k % 4 == 0, "['ORIGINAL', 'PRIMARY']").when(k % 4 == 1, "None").otherwise("DERIVED").alias("image_type"),
        F.when(k % 5 == 0, "[2.5, '']").when(k % 5 == 1, "1e-310").when(k % 5 == 2, "abc").otherwise("30").alias("ECHO_TIME"), F.when(k % 2 == 0, "['', 7]").otherwise("12.9").alias("echo_train_length"), F.lit("[1, 2]").alias("echo_number"),
    )
    return instances, rows


def import_instance_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an instance import reads of its file."""
    return M.instance_values(_instances(spark, sf_dir)[1])


def import_instances_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances after the import."""
    instances, rows = _instances(spark, sf_dir)
    return M.update_instances(instances, M.instance_values(rows).drop("echo_numbers"))[0]


def import_subject_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A checked table of subject codes."""
    rows = _table(spark, sf_dir, "orders").select(F.concat(F.lit(" P"), "o_custkey").alias("patient"), F.concat(F.lit("C"), "o_custkey", F.lit(" ")).alias("code"))
    return M.subject_codes(rows.union(rows.select(F.lit(" "), F.lit(None).cast("string"))), "patient", "code")


def cohort_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohorts after rows with names in any case."""
    nations = _table(spark, sf_dir, "nation")
    old = nations.filter("n_nationkey < 10").select(F.col("n_nationkey").cast("long").alias("cohort_id"), F.lower("n_name").alias("name"), F.lit("o").alias("owner"), F.lit("/p").alias("path"), F.lit("d").alias("description"), (F.col("n_nationkey") % 2 == 0).alias("is_active"))
    rows = nations.filter("n_nationkey % 3 = 0").select(F.concat(F.lit(" "), F.initcap("n_name")).alias("name"), F.lit("new ").alias("owner"), F.concat(F.lit("/q/"), "n_nationkey").alias("path"), F.lit(" ").alias("description"), F.when(F.col("n_nationkey") % 2 == 1, False).alias("is_active"))
    found = M.upsert_cohorts(old, rows)
    return found.select(F.when(F.col("cohort_id") < 10, F.col("cohort_id")).alias("known_id"), "name", "owner", "path", "description", "is_active")


def identifier_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of identifiers after new ones, with their counts."""
    segments = _table(spark, sf_dir, "customer").select("c_mktsegment").distinct()
    old = segments.filter("c_mktsegment < 'C'").select(F.ascii("c_mktsegment").cast("long").alias("id"), F.initcap("c_mktsegment").alias("name"), F.lit(None).cast("string").alias("description"))
    new = segments.select(F.concat(F.lit(" "), F.lower("c_mktsegment")).alias("name"), F.lit("x").alias("description")).union(segments.select(F.lit(" ").alias("name"), F.lit("y").alias("description")))
    types, _ = M.create_id_types(old, new)
    used = _table(spark, sf_dir, "customer").join(types.select("id", F.lower("name").alias("k")), F.lower("c_mktsegment") == F.col("k")).filter("c_custkey % 2 = 0").select(F.col("id").alias("id_type_id"))
    return M.list_id_types(types, used).drop("id")


def birth_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in many forms: parts of one digit, mixed separators, months by name."""
    k, d = F.col("o_orderkey"), F.to_date("o_orderdate")
    forms = ("yyyy/M.d", "d_M yyyy", "d MMMM yyyy", "MMM d, yyyy", "yyyy-MM-dd'T'HH:mm", "yyyyMMdd", "d-M-yyyy", "'born' yyyy")
    text = F.coalesce(*(F.when(k % len(forms) == i, F.date_format(d, f)) for i, f in enumerate(forms)))
    return _table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"), D.birth_date(text).alias("birth_date"))


def sequence_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence names without vendors' marks."""
    raw = F.element_at(F.array(*map(F.lit, ("*fl3d1", "*TFL_3D", "se", "", "*"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return _table(spark, sf_dir, "part").select("p_partkey", T.sequence_name(raw).alias("with_marks"), T.normalise(F.replace(raw, F.lit("*"), F.lit(""))).alias("without"))


_ALL = (import_instance_values, import_instances_update, import_subject_codes, cohort_upsert, identifier_types, birth_dates, sequence_names)
QUERIES = {f.__name__: f for f in _ALL}

_VALUES = """v AS (SELECT o_orderkey AS instance_id, CASE o_orderkey % 4 WHEN 0 THEN 'ORIGINAL' || chr(92) || 'PRIMARY' WHEN 1 THEN NULL ELSE 'DERIVED' END AS image_type, CASE o_orderkey % 5 WHEN 0 THEN 2.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE WHEN 2 THEN NULL ELSE 30.0::DOUBLE END AS echo_time,
    CASE WHEN o_orderkey % 2 = 0 THEN 7 ELSE 12 END AS echo_train_length, '1' || chr(92) || '2' AS echo_numbers FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 50 <> 1)"""

ORACLE_SQL = {
    "import_instance_values": f"WITH {_VALUES} SELECT * FROM v",
    "import_instances_update": f"WITH {_VALUES} SELECT o_orderkey AS instance_id, 'path' AS file_path, CASE WHEN v.instance_id IS NULL THEN 'OLD' ELSE image_type END AS image_type, CASE WHEN v.instance_id IS NULL THEN 1.0::DOUBLE ELSE echo_time END AS echo_time, CASE WHEN v.instance_id IS NULL THEN 5 ELSE echo_train_length END AS echo_train_length FROM orders LEFT JOIN v ON o_orderkey = v.instance_id",
    "import_subject_codes": "SELECT DISTINCT 'P' || o_custkey AS old_id, 'C' || o_custkey AS new_id FROM orders",
    "cohort_upsert": """SELECT CASE WHEN n_nationkey < 10 THEN n_nationkey END AS known_id, lower(n_name) AS name, CASE WHEN n_nationkey % 3 = 0 THEN 'new' ELSE 'o' END AS owner, CASE WHEN n_nationkey % 3 = 0 THEN '/q/' || n_nationkey ELSE '/p' END AS path,
    CASE WHEN n_nationkey % 3 <> 0 THEN 'd' END AS description, CASE WHEN n_nationkey % 3 = 0 AND n_nationkey % 2 = 1 THEN false WHEN n_nationkey < 10 THEN n_nationkey % 2 = 0 ELSE true END AS is_active FROM nation WHERE n_nationkey < 10 OR n_nationkey % 3 = 0""",
    "identifier_types": """SELECT CASE WHEN c_mktsegment < 'C' THEN c_mktsegment[1] || lower(c_mktsegment[2:]) ELSE lower(c_mktsegment) END AS name, CASE WHEN c_mktsegment >= 'C' THEN 'x' END AS description, count(*) FILTER (c_custkey % 2 = 0) AS identifiers_count FROM customer GROUP BY c_mktsegment""",
    "birth_dates": """WITH x AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN strftime(d, '%Y/%-m.%-d') WHEN 1 THEN strftime(d, '%-d_%-m %Y') WHEN 2 THEN strftime(d, '%-d %B %Y') WHEN 3 THEN strftime(d, '%b %-d, %Y') WHEN 4 THEN strftime(d, '%Y-%m-%dT00:00') WHEN 5 THEN strftime(d, '%Y%m%d') WHEN 6 THEN strftime(d, '%-d-%-m-%Y') ELSE strftime(d, 'born %Y') END AS text,
    CASE WHEN o_orderkey % 8 < 7 THEN d END AS birth_date FROM x""",
    "sequence_names": "SELECT p_partkey, CASE WHEN p_partkey % 5 = 3 THEN NULL ELSE w END AS with_marks, w AS without FROM (SELECT p_partkey, ['fl3d1', 'tfl_3d', 'spin-echo', '', ''][p_partkey % 5 + 1] AS w FROM part)",
}
