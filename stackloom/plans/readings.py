"""Readings of header values, and the smaller joins, orders and summaries around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stackloom.functions import misc as V
from stackloom.operators import fingerprint as FP
from stackloom.sources import adapter as A
from stackloom.sources import files, headers


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dealt(values: tuple, key: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (key % len(values) + 1).cast("int"))


def header_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendor, tracer, echo number, flags of modality, and first path segment."""
    k = F.col("l_orderkey") + F.col("l_linenumber")
    first, rest = files.split_relative(_dealt(("a\\b/c", "a/b", "solo", ""), k))
    return _table(spark, sf_dir, "lineitem").select(
        F.concat_ws(".", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_id"),
        V.vendor(_dealt(("Siemens Healthineers", "general electric", None, "TOSHIBA MEC", "Agfa", "philips"), k)).alias("vendor"),
        FP.canonical_tracer(_dealt((None, " 18f-fdg ", "Ga68 PSMA-11", "zzz", ""), k)).alias("tracer"),
        V.echo_number(_dealt(("1", "2.0,3", "x", None, " 4 ,1"), k)).alias("echo"),
        V.calcium_score(_dealt(("CT", "MR"), k), _dealt(("CaScore", "chest", None), k)).alias("calcium"),
        V.attenuation_corrected(_dealt(("PT", "CT", "PET"), k), _dealt(("CTAC", " ", None, "x"), k)).alias("attenuation"),
        first.alias("segment"), rest.alias("rest"),
    )


def size_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes from text, and back."""
    k = F.col("o_orderkey")
    text = F.concat((k % 977).cast("string"), _dealt(("", " kb", "MiB", ".5 GiB", "tib", " zb"), k))
    return _table(spark, sf_dir, "orders").select("o_orderkey", V.size_bytes(text).alias("bytes"), V.size_text(k * k).alias("human"))


def header_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers that ingest lets in, by modality and class."""
    k = F.col("l_orderkey") + F.col("l_partkey")
    rows = _table(spark, sf_dir, "lineitem").select(
        F.when(k % 11 != 0, F.col("l_orderkey").cast("string")).alias("study_uid"), F.when(k % 13 != 0, "s").otherwise("").alias("series_uid"), F.lit("i").alias("sop_uid"),
        F.concat(F.lit("1.2.840.10008.5.1.4.1.1."), _dealt(("4", "2.1", "7", "128"), k)).alias("sop_class_uid"), _dealt((" mr", "CT", "us", None, "PET "), F.floor(k / 4)).alias("modality"),
    )
    return headers.let_in(rows).groupBy("modality", "sop_class_uid").agg(F.count("*").alias("n"))


def outcome_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with stored outcomes."""
    k = F.col("o_orderkey")
    errors = V.outcome_errors(_dealt(("anat", "odd", "excluded"), k), _dealt((None, "T1w"), k), _dealt((None, "", "ADC"), F.floor(k / 2)), k % 3, F.when(k % 5 == 0, 2), (k % 4 == 0).cast("int"), _dealt((None, "base:x,oops", "bad"), k))
    return _table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(errors, "; ").alias("errors"))


def candidate_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of each order's candidates, the others, their mean, and whether it is close."""
    rows = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.concat_ws("-", "l_returnflag", "l_linestatus", "l_partkey").alias("value"), (F.col("l_quantity") / 50).alias("confidence"))).alias("c"))
    chosen = rows.withColumn("x", V.best_candidate(F.col("c")))
    mean = V.mean_confidence(F.transform("c", lambda y: y["confidence"]))
    return chosen.select("l_orderkey", F.col("x.best.value").alias("best"), F.size("x.others").alias("n_others"), F.round(mean, 6).alias("mean"), V.ambiguous(F.col("x.best"), F.col("x.others")).alias("close"))


def subjects_by_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects in the order of a chosen identifier, those without one last by code."""
    identifier = _table(spark, sf_dir, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("subject_id"), F.concat_ws("-", "c_mktsegment", "c_custkey").alias("identifier"))
    one = identifier.groupBy("subject_id").agg(F.min("identifier").alias("identifier"))
    return A.subjects(spark, sf_dir).join(one, "subject_id", "left").orderBy(F.col("identifier").asc_nulls_last(), "subject_code").select("subject_id", "subject_code", "identifier")


def session_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct items of the cohorts' series, most urgent first, then by id: the first 10 000."""
    series = A.instances(spark, sf_dir).select("series_id", "study_id", "image_type").distinct()
    rows = series.join(A.studies(spark, sf_dir), "study_id", "left").join(A.subject_cohorts(spark, sf_dir), "subject_id", "left").filter("cohort_id is not null")
    weighed = rows.select("series_id", F.when(F.col("image_type") == "R", 3).when(F.col("image_type") == "A", 2).otherwise(0).alias("priority")).distinct()
    return weighed.orderBy(F.desc("priority"), "series_id").limit(10_000)


def instance_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An instance's path with its cohort, where its subject has one (J18): one of each SOP key."""
    one = A.instances(spark, sf_dir).groupBy("sop_uid", "study_id").agg(F.min("series_id").alias("series_id"))
    member = A.subject_cohorts(spark, sf_dir).groupBy("subject_id").agg(F.min("cohort_id").alias("cohort_id"))
    found = one.join(A.studies(spark, sf_dir).select("study_id", "subject_id"), "study_id").join(member, "subject_id", "left").join(A.cohorts(spark, sf_dir), "cohort_id", "left")
    return found.select("sop_uid", F.concat_ws("/", "name", "subject_id", "series_id", "sop_uid").alias("path"))


def leaf_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of each folder by outcome, and its distinct tags."""
    outcome = F.col("o_orderstatus")
    return _table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("leaf"), F.col("o_custkey")).alias("leaf")).agg(
        F.count("*").alias("total"), F.count_if(outcome == "F").alias("written"), F.count_if(outcome == "O").alias("reused"), F.count_if(outcome == "P").alias("errors"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("tags")
    )


def next_sequence_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number after the largest numeric suffix of each segment's codes."""
    suffix = F.regexp_extract(F.col("c_name"), r"([0-9]+)$", 1).try_cast("long")
    return _table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg((F.coalesce(F.max(suffix), F.lit(0)) + 1).alias("next_number"))


def patient_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patients dealt in turn over seven workers, by name (O9): the turn is the number within a
    range of names plus the patients of the ranges before."""
    names = _table(spark, sf_dir, "customer").select("c_name").repartitionByRange("c_name").withColumn("part", F.spark_partition_id())
    counts = names.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = names.withColumn("own", F.row_number().over(Window.partitionBy("part").orderBy("c_name")) - 1)
    return own.join(F.broadcast(before), "part").select("c_name", ((F.col("own") + F.col("before")) % 7).cast("int").alias("worker"))  # one row a partition


def representative_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first non-empty comment of each stack."""
    rows = A.instances(spark, sf_dir).withColumn("comment", F.when(F.col("part_id") % 3 == 0, "").when(F.col("part_id") % 3 == 1, F.concat(F.lit("c"), "part_id")))
    return rows.filter("coalesce(comment, '') <> ''").groupBy("series_id", "image_type").agg(F.min(F.struct("instance_number", "sop_uid", "comment"))["comment"].alias("comment"))


def contrast_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A study's stacks before, after and without a known agent, as lists (Q19)."""
    state = F.when(F.col("te") > 35, "post").when(F.col("te") < 15, "pre").otherwise("unknown")
    stacks = A.instances(spark, sf_dir).select("study_id", "sop_uid", state.alias("state")).distinct()
    return stacks.groupBy("study_id").agg(*(F.array_join(F.array_sort(F.collect_set(F.when(F.col("state") == s, F.col("sop_uid")))), ",").alias(s) for s in ("pre", "post", "unknown")))


def preview_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose name or type match a pattern in any case."""
    return _table(spark, sf_dir, "part").filter(F.col("p_name").rlike("(?i)COLD|^s.*t$") | F.col("p_type").rlike("(?i)promo$")).select("p_partkey", "p_name", "p_type")


def sampled_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty folders drawn by a seeded hash, so reruns agree."""
    return _table(spark, sf_dir, "customer").select("c_custkey", F.md5(F.concat(F.lit("7:"), F.col("c_custkey"))).alias("draw")).orderBy("draw").limit(20)


def detail_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Details of each series, only where some detail is there (K8): new values win, blanks keep the old."""
    old = A.instances(spark, sf_dir).filter("image_type = 'A'").groupBy("series_id").agg(F.min("te").alias("te"), F.min("ti").alias("ti"))
    some = F.col("part_id") % 2 == 0
    new = A.instances(spark, sf_dir).groupBy("series_id").agg(F.max(F.when(some, F.col("te"))).alias("new_te"), F.max(F.when(some, F.col("ti"))).alias("new_ti")).filter("new_te is not null or new_ti is not null")
    joined = old.join(new, "series_id", "full")
    return joined.select("series_id", F.coalesce("new_te", "te").alias("te"), F.coalesce("new_ti", "ti").alias("ti"))


_ALL = (header_readings, size_strings, header_gate, outcome_validation, candidate_selection, subjects_by_identifier, session_items, instance_paths, leaf_summary, next_sequence_number, patient_partitions, representative_comments, contrast_pairs, preview_search, sampled_folders, detail_rows)
QUERIES = {f.__name__: f for f in _ALL}

ORACLE_SQL = {
    "header_readings": r"""
WITH x AS (SELECT concat_ws('.', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_id, l_orderkey + l_linenumber AS k FROM lineitem)
SELECT row_id, ['SIEMENS', 'GE', 'OTHER', 'CANON', 'OTHER', 'PHILIPS'][k % 6 + 1] AS vendor, [NULL, 'FDG', 'PSMA', 'ZZZ', NULL][k % 5 + 1] AS tracer, [1, 2, NULL, NULL, 4][k % 5 + 1] AS echo,
    CASE WHEN k % 2 = 0 THEN CAST(k % 3 = 0 AS INTEGER) END AS calcium, CASE WHEN k % 3 <> 1 THEN CAST(k % 4 IN (0, 3) AS INTEGER) END AS attenuation,
    ['a', 'a', 'solo', ''][k % 4 + 1] AS segment, ['b/c', 'b', NULL, NULL][k % 4 + 1] AS rest FROM x""",
    "size_strings": """
WITH x AS (SELECT o_orderkey, o_orderkey % 977 AS n, o_orderkey % 6 AS u, o_orderkey * o_orderkey AS b FROM orders)
SELECT o_orderkey, CAST(CASE u WHEN 0 THEN n WHEN 1 THEN n * 1000 WHEN 2 THEN n * 1048576 WHEN 3 THEN n * 1073741824 + 536870912 WHEN 4 THEN n * 1099511627776 END AS BIGINT) AS bytes,
    CASE WHEN b >= 1099511627776 THEN printf('%.2f TiB', b / 1099511627776.0::DOUBLE) WHEN b >= 1073741824 THEN printf('%.2f GiB', b / 1073741824.0::DOUBLE) WHEN b >= 1048576 THEN printf('%.2f MiB', b / 1048576.0::DOUBLE)
    WHEN b >= 1024 THEN printf('%.2f KiB', b / 1024.0::DOUBLE) ELSE b || ' B' END AS human FROM x""",
    "header_gate": """
WITH x AS (SELECT l_orderkey + l_partkey AS k FROM lineitem)
SELECT ['MR', 'CT', NULL, NULL, 'PET'][(k // 4) % 5 + 1] AS modality, '1.2.840.10008.5.1.4.1.1.' || ['4', '2.1', '7', '128'][k % 4 + 1] AS sop_class_uid, count(*) AS n FROM x
WHERE k % 11 <> 0 AND k % 13 <> 0 AND k % 4 <> 2 AND (k // 4) % 5 IN (0, 1, 4) GROUP BY ALL""",
    "outcome_validation": """
WITH x AS (SELECT o_orderkey, o_orderkey AS k FROM orders)
SELECT o_orderkey, concat_ws('; ', CASE WHEN k % 4 <> 0 AND k % 3 <> 2 AND k % 2 = 0 AND (k // 2) % 3 <> 2 THEN 'Non-localizer must have base or construct' END, CASE WHEN k % 3 = 1 THEN 'Invalid directory_type: odd' END,
    CASE WHEN k % 3 = 2 THEN 'Invalid post_contrast value: 2' END, CASE WHEN k % 5 = 0 THEN 'Invalid spinal_cord value: 2' END,
    CASE k % 3 WHEN 1 THEN 'Invalid review reason format: oops' WHEN 2 THEN 'Invalid review reason format: bad' END) AS errors FROM x""",
    "candidate_selection": """
WITH c AS (SELECT l_orderkey, concat_ws('-', l_returnflag, l_linestatus, l_partkey) AS value, l_quantity / 50 AS p FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY p DESC, value) AS n FROM c)
SELECT l_orderkey, max(value) FILTER (n = 1) AS best, CAST(count(*) - 1 AS INTEGER) AS n_others, round(avg(p), 6) AS mean, coalesce(max(p) FILTER (n = 1) - max(p) FILTER (n = 2) < 0.1::DOUBLE, false) AS close FROM r GROUP BY 1""",
    "subjects_by_identifier": f"""WITH {A.CTES} SELECT subject_id, subject_code, CASE WHEN subject_id % 3 = 0 THEN c_mktsegment || '-' || c_custkey END AS identifier
FROM subject JOIN customer ON c_custkey = subject_id ORDER BY identifier NULLS LAST, subject_code""",
    "session_items": f"""WITH {A.CTES}, x AS (SELECT DISTINCT series_id, CASE image_type WHEN 'R' THEN 3 WHEN 'A' THEN 2 ELSE 0 END AS priority FROM instance JOIN study USING (study_id)
WHERE subject_id IN (SELECT subject_id FROM subject_cohort)) SELECT * FROM x ORDER BY priority DESC, series_id LIMIT 10000""",
    "instance_paths": f"""WITH {A.CTES}, m AS (SELECT subject_id, min(cohort_id) AS cohort_id FROM subject_cohort GROUP BY 1), o AS (SELECT sop_uid, study_id, min(series_id) AS series_id FROM instance GROUP BY 1, 2)
SELECT sop_uid, concat_ws('/', name, subject_id, series_id, sop_uid) AS path FROM o JOIN study USING (study_id) LEFT JOIN m USING (subject_id) LEFT JOIN cohort USING (cohort_id)""",
    "leaf_summary": """SELECT 'leaf' || o_custkey AS leaf, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS written, count(*) FILTER (o_orderstatus = 'O') AS reused, count(*) FILTER (o_orderstatus = 'P') AS errors,
    string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS tags FROM orders GROUP BY o_custkey""",
    "next_sequence_number": "SELECT c_mktsegment, coalesce(max(TRY_CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT)), 0) + 1 AS next_number FROM customer GROUP BY 1",
    "patient_partitions": "SELECT c_name, CAST((row_number() OVER (ORDER BY c_name) - 1) % 7 AS INTEGER) AS worker FROM customer",
    "representative_comments": f"WITH {A.CTES} SELECT DISTINCT ON (series_id, image_type) series_id, image_type, 'c' || part_id AS comment FROM instance WHERE part_id % 3 = 1 ORDER BY series_id, image_type, instance_number, sop_uid, 'c' || part_id",
    "contrast_pairs": f"""WITH {A.CTES}, s AS (SELECT DISTINCT study_id, sop_uid, CASE WHEN te > 35 THEN 'post' WHEN te < 15 THEN 'pre' ELSE 'unknown' END AS st FROM instance)
SELECT study_id, """ + ", ".join(f"coalesce(string_agg(sop_uid, ',' ORDER BY sop_uid) FILTER (st = '{x}'), '') AS {x}" for x in ("pre", "post", "unknown")) + " FROM s GROUP BY 1",
    "preview_search": "SELECT p_partkey, p_name, p_type FROM part WHERE lower(p_name) LIKE '%cold%' OR lower(p_name) LIKE 's%t' OR lower(p_type) LIKE '%promo'",
    "sampled_folders": "SELECT c_custkey, md5('7:' || c_custkey) AS draw FROM customer ORDER BY draw LIMIT 20",
    "detail_rows": f"""WITH {A.CTES}, o AS (SELECT series_id, min(te) AS te, min(ti) AS ti FROM instance WHERE image_type = 'A' GROUP BY 1), n AS (SELECT series_id, max(te) AS a, max(ti) AS b FROM instance WHERE part_id % 2 = 0 GROUP BY 1)
SELECT series_id, coalesce(a, te) AS te, coalesce(b, ti) AS ti FROM o FULL JOIN (SELECT * FROM n WHERE a IS NOT NULL OR b IS NOT NULL) USING (series_id)""",
}
