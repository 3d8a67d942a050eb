"""Cohort scope and metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stackloom.operators.explore import found_subjects
from stackloom.operators.identity import timepoint
from stackloom.sources import adapter as A

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _zero(c: str):
    return F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)


def cohort_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects, studies, series and instances of each cohort, zeros included."""
    members = A.subject_cohorts(spark, sf_dir)
    subjects = members.groupBy("cohort_id").agg(F.count_distinct("subject_id").alias("n_subjects"))
    # Rows are counted per study first: each study belongs to one subject, so sums stay exact.
    files = A.instances(spark, sf_dir).groupBy("study_id").agg(F.count_distinct("series_id").alias("series"), F.count_distinct("sop_uid").alias("files"))
    per_subject = A.studies(spark, sf_dir).join(files, "study_id", "left").groupBy("subject_id").agg(F.count("*").alias("studies"), F.sum("series").alias("series"), F.sum("files").alias("files"))
    held = members.join(per_subject, "subject_id").groupBy("cohort_id").agg(F.sum("studies").alias("n_studies"), F.sum("series").alias("n_series"), F.sum("files").alias("n_instances"))
    return A.cohorts(spark, sf_dir).join(subjects, "cohort_id", "left").join(held, "cohort_id", "left").select("cohort_id", "name", *map(_zero, ("n_subjects", "n_studies", "n_series", "n_instances")))


def all_cohort_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members, studies and latest study date of every cohort as grouped joins."""
    members = A.subject_cohorts(spark, sf_dir)
    studies = A.studies(spark, sf_dir).groupBy("subject_id").agg(F.count("*").alias("n"), F.max("study_date").alias("latest"))
    stats = members.join(studies, "subject_id", "left").groupBy("cohort_id").agg(F.count("*").alias("n_members"), F.sum("n").alias("n_studies"), F.max("latest").alias("latest_study"))
    return A.cohorts(spark, sf_dir).join(stats, "cohort_id", "left").select("name", _zero("n_members"), _zero("n_studies"), "latest_study")


def active_subjects_in_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active subjects of cohort 1."""
    members = A.subject_cohorts(spark, sf_dir).filter("cohort_id = 1")
    return A.subjects(spark, sf_dir).filter("is_active").join(members, "subject_id").select("subject_id", "subject_code")


def studies_with_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Studies that have a series."""
    return A.studies(spark, sf_dir).join(A.instances(spark, sf_dir).select("study_id"), "study_id", "left_semi").select("study_id", "subject_id", "modality")


def series_for_studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series with columns of their study and subject, those with an instance."""
    series = A.instances(spark, sf_dir).select("series_id", "study_id").distinct()
    return series.join(A.studies(spark, sf_dir), "study_id").join(A.subjects(spark, sf_dir), "subject_id").select("series_id", "study_id", "subject_code", "study_date", "modality")


def modality_filter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MR and CT series, or those whose image type rescues them; only the former count by
    modality (P7)."""
    series = A.instances(spark, sf_dir).select("series_id", "study_id", "image_type").distinct().join(A.studies(spark, sf_dir).select("study_id", "modality"), "study_id")
    kept = series.filter(F.col("modality").isin("MR", "CT") | (F.col("image_type") == "R"))
    counted = F.when(F.col("modality").isin("MR", "CT"), F.col("modality"))
    return kept.groupBy(counted.alias("counted_as")).agg(F.count("*").alias("n"))


def unclassified_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series without a row in the classification cache."""
    cached = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("series_id"))
    return A.instances(spark, sf_dir).select("series_id").distinct().join(cached, "series_id", "left_anti")


def study_date_imputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A missing study date becomes the study's earliest acquisition date."""
    earliest = A.instances(spark, sf_dir).groupBy("study_id").agg(F.min("acquisition_date").alias("earliest"))
    joined = A.studies(spark, sf_dir).join(earliest, "study_id", "left")
    return joined.select("study_id", F.coalesce("study_date", "earliest").alias("study_date"), (F.col("study_date").isNull() & F.col("earliest").isNotNull()).alias("imputed"))


def subjects_with_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects with their other identifiers as JSON, [] if none."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    ids = customer.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("subject_id"), F.concat_ws("-", "c_mktsegment", "c_custkey").alias("value"))
    listed = ids.groupBy("subject_id").agg(F.to_json(F.array_sort(F.collect_list("value"))).alias("ids"))
    return A.subjects(spark, sf_dir).join(listed, "subject_id", "left").select("subject_id", "subject_code", F.coalesce("ids", F.lit("[]")).alias("other_ids"))


_SEARCHES = ("building-1", "R#%7_3", "42")


def subject_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects of a cohort by a part of their code, id or any other identifier."""
    ids = spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("subject_id"), F.concat_ws("-", "c_mktsegment", "c_custkey").alias("value"))
    members = A.subject_cohorts(spark, sf_dir).filter("cohort_id = 2").select("subject_id")
    scope = A.subjects(spark, sf_dir).join(members, "subject_id", "left_semi").select("subject_id", "subject_code")
    return reduce(DataFrame.union, (found_subjects(scope, ids, text).select(F.lit(text).alias("search"), "subject_id", "subject_code") for text in _SEARCHES))


def sessions_per_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of each subject with their modalities (A15); an unknown date stays null."""
    grouped = A.studies(spark, sf_dir).groupBy("subject_id", "study_date").agg(F.array_join(F.array_sort(F.collect_set("modality")), ",").alias("modalities"), F.count("*").alias("n_studies"))
    return grouped


def timepoint_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months since a subject's first study, snapped to the nearest half year within one."""
    first = F.min("study_date").over(Window.partitionBy("subject_id"))
    dated = A.studies(spark, sf_dir).filter("study_date is not null").withColumn("first", first)
    return dated.select("study_id", "subject_id", timepoint(F.col("first"), F.col("study_date")).alias("timepoint"), F.datediff("study_date", "first").alias("days"))


def table_counts_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts of all tables in one statement."""
    counts = (spark.read.parquet(f"{sf_dir}/{t}.parquet").agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n") for t in TABLES)
    return reduce(DataFrame.unionByName, counts)


QUERIES = {f.__name__: f for f in (cohort_metrics, all_cohort_stats, active_subjects_in_cohort, studies_with_series, series_for_studies, modality_filter_counts, unclassified_series, study_date_imputation, subjects_with_identifiers, subject_search, sessions_per_subject, timepoint_labels, table_counts_union)}

ORACLE_SQL = {
    "cohort_metrics": f"""
WITH {A.CTES}
SELECT c.cohort_id, c.name, count(DISTINCT m.subject_id) AS n_subjects, count(DISTINCT s.study_id) AS n_studies,
    count(DISTINCT i.series_id) AS n_series, count(DISTINCT i.sop_uid) AS n_instances
FROM cohort c LEFT JOIN subject_cohort m USING (cohort_id) LEFT JOIN study s ON s.subject_id = m.subject_id LEFT JOIN instance i ON i.study_id = s.study_id
GROUP BY ALL""",
    "all_cohort_stats": f"""
WITH {A.CTES}
SELECT name, (SELECT count(*) FROM subject_cohort m WHERE m.cohort_id = c.cohort_id) AS n_members,
    (SELECT count(*) FROM subject_cohort m JOIN study s USING (subject_id) WHERE m.cohort_id = c.cohort_id) AS n_studies,
    (SELECT max(study_date) FROM subject_cohort m JOIN study s USING (subject_id) WHERE m.cohort_id = c.cohort_id) AS latest_study
FROM cohort c""",
    "active_subjects_in_cohort": f"WITH {A.CTES} SELECT subject_id, subject_code FROM subject JOIN subject_cohort USING (subject_id) WHERE is_active AND cohort_id = 1",
    "studies_with_series": f"WITH {A.CTES} SELECT study_id, subject_id, modality FROM study s WHERE EXISTS (SELECT 1 FROM instance i WHERE i.study_id = s.study_id)",
    "series_for_studies": f"WITH {A.CTES} SELECT DISTINCT series_id, study_id, subject_code, study_date, modality FROM instance JOIN study USING (study_id) JOIN subject USING (subject_id)",
    "modality_filter_counts": f"""
WITH {A.CTES}, s AS (SELECT DISTINCT series_id, image_type, modality FROM instance JOIN study USING (study_id))
SELECT CASE WHEN modality IN ('MR', 'CT') THEN modality END AS counted_as, count(*) AS n FROM s WHERE modality IN ('MR', 'CT') OR image_type = 'R' GROUP BY 1""",
    "unclassified_series": f"WITH {A.CTES} SELECT DISTINCT series_id FROM instance i WHERE NOT EXISTS (SELECT 1 FROM labels WHERE doc_id = i.series_id)",
    "study_date_imputation": f"""
WITH {A.CTES}, e AS (SELECT study_id, min(acquisition_date) AS earliest FROM instance GROUP BY 1)
SELECT study_id, coalesce(study_date, earliest) AS study_date, study_date IS NULL AND earliest IS NOT NULL AS imputed FROM study LEFT JOIN e USING (study_id)""",
    "subjects_with_identifiers": f"""
WITH {A.CTES}
SELECT subject_id, subject_code, CASE WHEN subject_id % 3 = 0 THEN '["' || c_mktsegment || '-' || c_custkey || '"]' ELSE '[]' END AS other_ids
FROM subject JOIN customer ON c_custkey = subject_id""",
    "subject_search": f"""
WITH {A.CTES}, q AS (SELECT unnest({list(_SEARCHES)}) AS search), x AS (SELECT subject_id, subject_code, CASE WHEN subject_id % 3 = 0 THEN c_mktsegment || '-' || c_custkey ELSE '' END AS other FROM subject JOIN customer ON c_custkey = subject_id
    WHERE subject_id IN (SELECT subject_id FROM subject_cohort WHERE cohort_id = 2))
SELECT search, subject_id, subject_code FROM x, q WHERE subject_code ILIKE '%' || search || '%' OR CAST(subject_id AS VARCHAR) ILIKE '%' || search || '%' OR other ILIKE '%' || search || '%'""",
    "sessions_per_subject": f"WITH {A.CTES} SELECT subject_id, study_date, string_agg(DISTINCT modality, ',' ORDER BY modality) AS modalities, count(*) AS n_studies FROM study GROUP BY 1, 2",
    "timepoint_labels": f"""
WITH {A.CTES}, f AS (SELECT *, min(study_date) OVER (PARTITION BY subject_id) AS d0 FROM study WHERE study_date IS NOT NULL),
a AS (SELECT *, (year(study_date) - year(d0)) * 12 + month(study_date) - month(d0) AS apart FROM f),
w AS (SELECT *, CASE WHEN d0 + apart * INTERVAL 1 MONTH > study_date THEN apart - 1 ELSE apart END AS whole FROM a),
m AS (SELECT *, CAST(round_even(whole + date_diff('day', CAST(d0 + whole * INTERVAL 1 MONTH AS DATE), study_date) / 30.44::DOUBLE, 0) AS INTEGER) AS months FROM w),
h AS (SELECT *, greatest(6, CAST(round_even(months / 6, 0) * 6 AS INTEGER)) AS half FROM m),
s AS (SELECT *, CASE WHEN months = 0 THEN 0 WHEN abs(months - half) <= 1 THEN half ELSE months END AS snapped FROM h)
SELECT study_id, subject_id, 'M' || CASE WHEN snapped > 99 THEN CAST(snapped AS VARCHAR) ELSE lpad(CAST(snapped AS VARCHAR), 2, '0') END AS timepoint, CAST(study_date - d0 AS INTEGER) AS days FROM s""",
    "table_counts_union": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in TABLES),
}
