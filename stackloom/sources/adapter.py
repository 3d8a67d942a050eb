"""Imaging-shaped tables derived from the relational test tables.

Each function returns a narrow DataFrame with the column names of the imaging model, so the
operators never see where the rows come from. The same expressions exist as DuckDB CTEs in
`CTES`, for the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that by_key deals to a task.
TASK_ROWS = 1_000_000


def by_key(rows: DataFrame, *keys: str, task_rows: int | None = None) -> DataFrame:
    """rows dealt by keys to so many tasks that each has about task_rows, counted before: what a task
    holds does not grow with the input. The number given is kept, where Spark would join small partitions to large tasks."""
    tasks = -(-rows.count() // (task_rows or TASK_ROWS))
    return rows.repartition(max(tasks, rows.sparkSession.sparkContext.defaultParallelism), *keys)


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("subject_id"), F.col("c_name").alias("subject_code"), (F.col("c_acctbal") >= 0).alias("is_active")
    )


def cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("int").alias("cohort_id"), F.lower("r_name").alias("name"))


def subject_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Home cohort of each subject, and a second one for every seventh."""
    home = _read(spark, sf_dir, "customer").join(_read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    first = home.select(F.col("c_custkey").alias("subject_id"), F.col("n_regionkey").cast("int").alias("cohort_id"))
    second = first.filter("subject_id % 7 = 0").withColumn("cohort_id", ((F.col("cohort_id") + 1) % 5).cast("int"))
    return first.union(second)


def studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    priority = F.substring("o_orderpriority", 1, 1)
    modality = F.when(priority.isin("1", "2"), "MR").when(priority == "3", "CT").when(priority == "4", "PT").otherwise("OT")
    return _read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("study_id"),
        F.col("o_custkey").alias("subject_id"),
        F.when(F.col("o_orderkey") % 11 != 0, F.to_date("o_orderdate")).alias("study_date"),
        modality.alias("modality"),
    )


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header rows, duplicates of a SOP key included."""
    return _read(spark, sf_dir, "lineitem").select(
        F.concat_ws(".", "l_orderkey", "l_linenumber").alias("sop_uid"),
        F.col("l_orderkey").alias("study_id"),
        (F.col("l_orderkey") * 3 + F.col("l_suppkey") % 3).alias("series_id"),
        F.col("l_linenumber").alias("instance_number"),
        F.col("l_partkey").alias("part_id"),
        F.col("l_suppkey").alias("supplier_id"),
        F.col("l_quantity").alias("te"),
        (F.col("l_extendedprice") / 10).alias("tr"),
        F.when(F.col("l_tax") != 0, F.col("l_tax") * 10000).alias("ti"),
        (F.col("l_discount") * 1000).alias("fa"),
        F.col("l_returnflag").alias("image_type"),
        F.col("l_linestatus").alias("coil"),
        F.floor(F.col("l_quantity") / 10).cast("int").alias("echo_numbers"),
        F.to_date("l_shipdate").alias("acquisition_date"),
    )


#: The same tables for DuckDB, as a WITH list.
CTES = """
subject AS (SELECT c_custkey AS subject_id, c_name AS subject_code, c_acctbal >= 0 AS is_active FROM customer),
cohort AS (SELECT CAST(r_regionkey AS INTEGER) AS cohort_id, lower(r_name) AS name FROM region),
home AS (SELECT c_custkey AS subject_id, CAST(n_regionkey AS INTEGER) AS cohort_id FROM customer JOIN nation ON c_nationkey = n_nationkey),
subject_cohort AS (SELECT * FROM home UNION ALL SELECT subject_id, CAST((cohort_id + 1) % 5 AS INTEGER) FROM home WHERE subject_id % 7 = 0),
study AS (SELECT o_orderkey AS study_id, o_custkey AS subject_id,
    CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderdate AS DATE) END AS study_date,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'MR' WHEN '2' THEN 'MR' WHEN '3' THEN 'CT' WHEN '4' THEN 'PT' ELSE 'OT' END AS modality FROM orders),
instance AS (SELECT concat_ws('.', l_orderkey, l_linenumber) AS sop_uid, l_orderkey AS study_id, l_orderkey * 3 + l_suppkey % 3 AS series_id,
    l_linenumber AS instance_number, l_partkey AS part_id, l_suppkey AS supplier_id, l_quantity AS te, l_extendedprice / 10 AS tr,
    CASE WHEN l_tax <> 0 THEN l_tax * 10000 END AS ti, l_discount * 1000 AS fa, l_returnflag AS image_type, l_linestatus AS coil,
    CAST(floor(l_quantity / 10) AS INTEGER) AS echo_numbers, CAST(l_shipdate AS DATE) AS acquisition_date FROM lineitem)
""".strip()
