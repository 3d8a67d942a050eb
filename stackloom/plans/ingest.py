"""Ingest: keys, duplicates, conflicts, stacks and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stackloom.operators import stacks as K
from stackloom.operators import upsert as U
from stackloom.sources import adapter as A

#: Order that settles which of several rows with one SOP key is first.
_ORDER = ["part_id", "supplier_id", "te", "tr"]


def dedupe_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each SOP key."""
    first = U.first_per_key(A.instances(spark, sf_dir), ["sop_uid"], [F.col(c) for c in _ORDER])
    return first.select("sop_uid", "study_id", "series_id", "part_id", "te")


def ingest_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SOP keys that came more than once, or under several series (K4, K9)."""
    rows = A.by_key(A.instances(spark, sf_dir).select("sop_uid", "series_id"), "sop_uid")
    grouped = rows.groupBy("sop_uid").agg(F.count("*").alias("n_rows"), F.count_distinct("series_id").alias("n_series"))
    return grouped.filter("n_rows > 1").select("sop_uid", F.when(F.col("n_series") > 1, "series").otherwise("instance").alias("scope"), "n_rows", "n_series")


def assign_dimension_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of series: known ones keep theirs, new ones follow (K3). Reported as the number of
    ids, distinct ids and the largest, as the order within hash ranges is Spark's own."""
    series = A.instances(spark, sf_dir).select("series_id").distinct()
    known = series.filter("series_id % 2 = 0").select("series_id", F.col("series_id").alias("id")).filter("id <= 1000")
    ids = U.assign_ids(known, series, "series_id", "id")
    return ids.agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_distinct"), F.max("id").alias("top"))


def dimension_ids_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every series with the id that it keeps, or that it got one beyond all known ids (K3)."""
    series = A.instances(spark, sf_dir).select("series_id").distinct()
    known = series.filter("series_id % 3 = 0").select("series_id", (F.col("series_id") * 2 + 1).alias("id")).filter("id <= 2000")
    ids = U.assign_ids(known, series, "series_id", "id").select("series_id", "id")
    had = known.select("series_id", F.col("id").alias("kept_id"))
    return ids.join(had, "series_id", "left").join(F.broadcast(known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")))).select("series_id", "kept_id", (F.col("id") == F.col("kept_id")).alias("unchanged"), F.when(F.col("kept_id").isNull(), F.col("id") > F.col("top")).alias("beyond"))  # one row


def orphan_parent_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents without children and children without parents."""
    sides = A.studies(spark, sf_dir).select("study_id", F.lit(1).alias("parent")).union(A.instances(spark, sf_dir).select("study_id", F.lit(0)))
    met = A.by_key(sides, "study_id").groupBy("study_id").agg(F.sum("parent").alias("parents"), F.sum(1 - F.col("parent")).alias("children"))
    null = F.col("study_id").isNull()  # matches nothing
    childless = F.when(null | (F.col("children") == 0), F.col("parents")).otherwise(0).cast("int")
    parentless = F.when(null | (F.col("parents") == 0), F.least("children", F.lit(1))).otherwise(0).cast("int")
    problems = F.concat(F.array_repeat(F.lit("study without instance"), childless), F.array_repeat(F.lit("instance without study"), parentless))
    return met.select(F.explode(problems).alias("problem"), F.col("study_id").alias("key"))


def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances with all fields of a stack's signature: orders are series of MR, CT or PET images,
    and what varies within a series follows from its number."""
    o, line = F.col("l_orderkey"), F.col("l_linenumber")
    kind, what, half = o % 3, F.floor(o / 3) % 12, line % 2
    varies = lambda *which: half * what.isin(*which).cast("int")
    of = lambda modality, value: F.when(kind == modality, value)
    noise = (F.col("l_suppkey") % 3) * 0.001  # less than the rounding
    plane = F.element_at(F.array(*map(F.lit, ("Axial", "Coronal"))), (varies(3, 11) + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        o.alias("series_id"), F.concat_ws(".", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").alias("sop_uid"), line.alias("line"),
        of(0, 10.0 + 5.25 * varies(0, 1) + noise).alias("echo_time"), of(0, F.when(what == 4, 900.0 + 50 * varies(4))).alias("inversion_time"), of(0, (1 + varies(1)).cast("string")).alias("echo_numbers"),
        of(0, 7 + varies(10)).alias("echo_train_length"), of(0, 2000.0 + 100 * varies(7, 9) + noise).alias("repetition_time"), of(0, F.when(what != 5, F.lit(90.0)).when(half == 0, 30.0)).alias("flip_angle"),
        of(0, F.when(varies(6, 9) == 1, "HEA;HEP").otherwise("HEA")).alias("receive_coil_name"), of(1, 100 + varies(0)).cast("string").alias("xray_exposure"), of(1, 120.0 + 20 * varies(1, 2) + noise).alias("kvp"),
        of(1, 200.0 + 10 * varies(2) + 10 * noise).alias("tube_current"), of(2, varies(0, 1)).cast("int").alias("pet_bed_index"), of(2, F.when(varies(1, 2) == 1, "dynamic").otherwise("static")).alias("pet_frame_type"),
        plane.alias("orientation"), F.when(varies(8) == 1, "DERIVED").when(what == 8, None).otherwise("ORIGINAL").alias("image_type"),
    )


def stack_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stacks over all signature fields in two runs: what the first run has found keeps its index,
    the second's new ones follow (A6, K5, W2)."""
    rows = _headers(spark, sf_dir)
    first = K.ensure_stacks(rows.filter("line between 2 and 3"), None)
    return K.ensure_stacks(rows, first).drop("first_instance")


def stack_of_instance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each instance with the index of its stack (K5)."""
    rows = _headers(spark, sf_dir)
    return K.stack_of_instances(rows, K.ensure_stacks(rows)).select("sop_uid", "series_id", "stack_index")


def stack_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What varies between a series' stacks."""
    return K.stack_key(K.ensure_stacks(_headers(spark, sf_dir)))


def stack_instance_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored counts replaced by counted ones where there are rows."""
    stacks = A.instances(spark, sf_dir).select("series_id", "image_type").distinct().withColumn("stored", F.lit(0).cast("long"))
    counted = A.instances(spark, sf_dir).filter("te >= 10").groupBy("series_id", "image_type").agg(F.count("*").alias("n"))
    return stacks.join(counted, ["series_id", "image_type"], "left").select("series_id", "image_type", F.coalesce("n", "stored").alias("stack_n_instances"))


def stack_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series with one stack and with several, the most stacks; confidences: mean, least, and how
    many lie below 0.85 (A8, A9)."""
    stacks = A.instances(spark, sf_dir).groupBy("series_id", "image_type").agg((F.min("fa") / 100).alias("confidence"))
    sizes = stacks.groupBy("series_id").agg(F.count("*").alias("n"), F.min("confidence").alias("low"), F.sum("confidence").alias("all"), F.count_if(F.col("confidence") < 0.85).alias("n_low"))
    counts = [F.count_if(F.col("n") == 1).alias("single"), F.count_if(F.col("n") > 1).alias("multi"), F.max("n").alias("most"), F.min("low").alias("least_confidence"), F.sum("n_low").alias("n_low")]
    return sizes.agg(*counts, F.round(F.sum("all") / F.sum("n"), 6).alias("mean_confidence"))


def first_instance_per_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first instance of each stack (A5)."""
    row = F.struct("sop_uid", *_ORDER)
    first = A.instances(spark, sf_dir).groupBy("series_id", "image_type").agg(F.min(row).alias("r"))
    return first.select("series_id", "image_type", "r.sop_uid", "r.part_id", "r.te")


def resume_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows after a token, without those whose path is known."""
    rows = A.instances(spark, sf_dir).select("sop_uid", "series_id", F.concat_ws("/", "study_id", "instance_number").alias("path")).distinct()
    known = rows.filter("series_id % 5 = 0").select("path")
    return rows.filter("sop_uid > '2'").join(known, "path", "left_anti").select("sop_uid", "path")


def sister_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other series of the same study with their instances."""
    counted = A.instances(spark, sf_dir).groupBy("study_id", "series_id").agg(F.count_distinct("sop_uid").alias("n_instances"))
    other = counted.select("study_id", F.col("series_id").alias("sister_id"), "n_instances")
    return counted.select("study_id", "series_id").join(other, "study_id").filter("series_id != sister_id").select("series_id", "sister_id", "n_instances")


def middle_instance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle instance of each series by location."""
    place = F.struct(F.coalesce("ti", "te").alias("at"), F.col("sop_uid"))
    grouped = A.instances(spark, sf_dir).groupBy("series_id").agg(F.array_sort(F.collect_set(place)).alias("r"))
    return grouped.select("series_id", F.element_at("r", (F.floor(F.size("r") / 2) + 1).cast("int"))["sop_uid"].alias("sop_uid"))


def _subject_import(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    old = customer.filter("c_custkey % 2 = 0").select(F.col("c_name").alias("subject_code"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    rows = customer.filter("c_custkey % 3 = 0").select("c_custkey", F.col("c_name").alias("subject_code"), F.when(F.col("c_custkey") % 6 != 0, F.upper("c_mktsegment")).alias("segment"), (-F.col("c_acctbal")).alias("balance"))
    return old, rows


def import_subjects_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imported rows replace and add; blanks keep the old value."""
    old, rows = _subject_import(spark, sf_dir)
    return U.merge_non_null(old, rows.drop("c_custkey"), ["subject_code"])


def import_memberships_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memberships of the listed subjects are replaced."""
    members = A.subject_cohorts(spark, sf_dir)
    listed = A.subjects(spark, sf_dir).filter("subject_id % 10 = 0").select("subject_id", F.lit(4).alias("cohort_id"))
    return U.delete_where_in(members, listed, ["subject_id"]).unionByName(listed)


def import_identifiers_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed identifiers are deleted and inserted, new ones inserted; each row says which
    (I4, J13, J14)."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    old = customer.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("subject_id"), F.col("c_mktsegment").alias("old_value"))
    new = customer.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("subject_id"), F.when(F.col("c_custkey") % 4 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")).alias("new_value"))
    joined = old.join(new, "subject_id", "full_outer")
    action = F.when(F.col("new_value").isNull(), "kept").when(F.col("old_value").isNull(), "inserted").when(F.col("old_value") != F.col("new_value"), "updated").otherwise("skipped")
    return joined.select("subject_id", F.coalesce("new_value", "old_value").alias("value"), action.alias("action"))


def table_explorer_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A searched, ordered page of a table with total and filtered counts."""
    from stackloom.operators.explore import explore

    return explore(spark.read.parquet(f"{sf_dir}/customer.parquet"), "auto", [("c_acctbal", False), ("c_custkey", True)], 10, 25)


def archive_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source packed in order into archives under a limit."""
    from stackloom.operators.packing import pack_ordered

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", F.col("doc_id").alias("name"), F.col("n_chars").alias("size"))
    return pack_ordered(documents, "source", "name", "size", 50_000).select("source", "name", "size", "chunk")


def _sized_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", F.col("doc_id").alias("name"), F.col("n_chars").alias("size"))


def archive_bin_packing_ffd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source packed by first-fit decreasing into archives under a limit."""
    from stackloom.operators.packing import pack_ffd

    return pack_ffd(_sized_documents(spark, sf_dir), "source", "name", "size", 50_000).drop("part")


def archive_chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archives of a first-fit packing: members, count and bytes."""
    from stackloom.operators.packing import chunk_plan, pack_ffd

    plan = chunk_plan(pack_ffd(_sized_documents(spark, sf_dir), "source", "name", "size", 50_000), "source", "name", "size")
    return plan.select("source", "chunk_id", F.array_join("members", ",").alias("members"), "n_members", "total_bytes")


QUERIES = {f.__name__: f for f in (dedupe_instances, ingest_conflicts, assign_dimension_ids, dimension_ids_kept, orphan_parent_audit, stack_discovery, stack_of_instance, stack_key, stack_instance_counts, stack_metrics, first_instance_per_stack, resume_filter, sister_series, middle_instance, import_subjects_upsert, import_memberships_replace, import_identifiers_replace, table_explorer_page, archive_bin_packing, archive_bin_packing_ffd, archive_chunk_plan)}

_FIELDS = ", ".join(K.SIGNATURE)
_NULLS = ", ".join(f"{c} NULLS FIRST" for c in K.SIGNATURE)
_SAME = " AND ".join(f"b.{c} IS NOT DISTINCT FROM one.{c}" for c in K.SIGNATURE)
_HEADERS = """h AS (SELECT l_orderkey AS series_id, concat_ws('.', l_orderkey, l_linenumber, l_suppkey, l_partkey) AS sop_uid, l_linenumber AS line, kind, what,
    CASE WHEN kind = 0 THEN CASE WHEN what IN (0, 1) AND half = 1 THEN 15.25::DOUBLE ELSE 10.0::DOUBLE END END AS echo_time,
    CASE WHEN kind = 0 AND what = 4 THEN CASE WHEN half = 1 THEN 950.0::DOUBLE ELSE 900.0::DOUBLE END END AS inversion_time,
    CASE WHEN kind = 0 THEN CASE WHEN what = 1 AND half = 1 THEN '2' ELSE '1' END END AS echo_numbers,
    CASE WHEN kind = 0 THEN CASE WHEN what = 10 AND half = 1 THEN 8 ELSE 7 END END::BIGINT AS echo_train_length,
    CASE WHEN kind = 0 THEN CASE WHEN what IN (7, 9) AND half = 1 THEN 2100.0::DOUBLE ELSE 2000.0::DOUBLE END END AS repetition_time,
    CASE WHEN kind = 0 THEN CASE WHEN what <> 5 THEN 90.0::DOUBLE WHEN half = 0 THEN 30.0::DOUBLE END END AS flip_angle,
    CASE WHEN kind = 0 THEN CASE WHEN what IN (6, 9) AND half = 1 THEN 'HEA;HEP' ELSE 'HEA' END END AS receive_coil_name,
    CASE WHEN kind = 1 THEN CASE WHEN what = 0 AND half = 1 THEN '101' ELSE '100' END END AS xray_exposure,
    CASE WHEN kind = 1 THEN CASE WHEN what IN (1, 2) AND half = 1 THEN 140.0::DOUBLE ELSE 120.0::DOUBLE END END AS kvp,
    CASE WHEN kind = 1 THEN CASE WHEN what = 2 AND half = 1 THEN 210.0::DOUBLE ELSE 200.0::DOUBLE END END AS tube_current,
    CASE WHEN kind = 2 THEN CASE WHEN what IN (0, 1) THEN half ELSE 0 END END::INTEGER AS pet_bed_index,
    CASE WHEN kind = 2 THEN CASE WHEN what IN (1, 2) AND half = 1 THEN 'dynamic' ELSE 'static' END END AS pet_frame_type,
    CASE WHEN what IN (3, 11) AND half = 1 THEN 'Coronal' ELSE 'Axial' END AS orientation,
    CASE WHEN what <> 8 THEN 'ORIGINAL' WHEN half = 1 THEN 'DERIVED' END AS image_type
    FROM (SELECT *, l_orderkey % 3 AS kind, (l_orderkey // 3) % 12 AS what, l_linenumber % 2 AS half FROM lineitem))"""

#: The bins of each source as a list that the recursion carries.
FFD = """
WITH RECURSIVE n AS (SELECT source, doc_id AS name, n_chars AS size, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents),
p AS (SELECT source, name, size, r, [size] AS used, 1::BIGINT AS chunk FROM n WHERE r = 1
    UNION ALL SELECT source, name, size, r, CASE WHEN fit IS NULL THEN list_append(used, size) ELSE list_transform(used, lambda u, i: CASE WHEN i = fit THEN u + size ELSE u END) END, coalesce(fit, len(used) + 1)
    FROM (SELECT n.source, n.name, n.size, n.r, p.used, nullif(list_position(list_transform(p.used, lambda u: u + n.size <= 50000), true), 0) AS fit FROM p JOIN n ON n.source IS NOT DISTINCT FROM p.source AND n.r = p.r + 1))"""

ORACLE_SQL = {
    "dedupe_instances": f"WITH {A.CTES} SELECT sop_uid, study_id, series_id, part_id, te FROM instance QUALIFY row_number() OVER (PARTITION BY sop_uid ORDER BY part_id, supplier_id, te, tr) = 1",
    "ingest_conflicts": f"WITH {A.CTES} SELECT sop_uid, CASE WHEN count(DISTINCT series_id) > 1 THEN 'series' ELSE 'instance' END AS scope, count(*) AS n_rows, count(DISTINCT series_id) AS n_series FROM instance GROUP BY sop_uid HAVING count(*) > 1",
    "dimension_ids_kept": f"""
WITH {A.CTES}, s AS (SELECT DISTINCT series_id FROM instance), k AS (SELECT series_id, CASE WHEN series_id % 3 = 0 AND series_id * 2 + 1 <= 2000 THEN series_id * 2 + 1 END AS kept_id FROM s)
SELECT series_id, kept_id, CASE WHEN kept_id IS NOT NULL THEN true END AS unchanged, CASE WHEN kept_id IS NULL THEN true END AS beyond FROM k""",
    "assign_dimension_ids": f"""
WITH {A.CTES}, s AS (SELECT DISTINCT series_id FROM instance), k AS (SELECT series_id FROM s WHERE series_id % 2 = 0 AND series_id <= 1000)
SELECT count(*) AS n, count(*) AS n_distinct, (SELECT coalesce(max(series_id), 0) FROM k) + count(*) - (SELECT count(*) FROM k) AS top FROM s""",
    "orphan_parent_audit": f"""
WITH {A.CTES} SELECT 'study without instance' AS problem, study_id AS key FROM study WHERE study_id NOT IN (SELECT study_id FROM instance)
UNION ALL SELECT DISTINCT 'instance without study', study_id FROM instance WHERE study_id NOT IN (SELECT study_id FROM study)""",
    "stack_discovery": f"""
WITH {_HEADERS}, a AS (SELECT series_id, {_FIELDS}, min(sop_uid) AS first FROM h WHERE line IN (2, 3) GROUP BY ALL),
one AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY first, {_NULLS}) - 1 AS i FROM a),
b AS (SELECT series_id, {_FIELDS}, min(sop_uid) AS first, count(*) AS n_instances FROM h GROUP BY ALL),
j AS (SELECT b.*, one.i FROM b LEFT JOIN one ON b.series_id = one.series_id AND {_SAME}),
two AS (SELECT *, row_number() OVER (PARTITION BY series_id, i IS NULL ORDER BY first, {_NULLS}) AS r, coalesce(max(i) OVER (PARTITION BY series_id), -1) AS top FROM j)
SELECT series_id, {_FIELDS}, n_instances, CAST(coalesce(i, top + r) AS INTEGER) AS stack_index, i IS NULL AS is_new FROM two""",
    "stack_of_instance": f"""
WITH {_HEADERS}, b AS (SELECT *, min(sop_uid) OVER (PARTITION BY series_id, {_FIELDS}) AS first FROM h)
SELECT sop_uid, series_id, CAST(dense_rank() OVER (PARTITION BY series_id ORDER BY first, {_NULLS}) - 1 AS INTEGER) AS stack_index FROM b""",
    "stack_key": f"""
WITH {_HEADERS}, s AS (SELECT series_id, CAST(count(DISTINCT ({_FIELDS})) AS BIGINT) AS n_stacks, min(kind) AS kind, min(what) AS what FROM h GROUP BY 1)
SELECT series_id, n_stacks, CASE WHEN n_stacks > 1 THEN CASE WHEN what IN (3, 11) THEN 'multi_orientation' WHEN what = 8 THEN 'image_type_variation'
    WHEN kind = 0 THEN CASE what WHEN 0 THEN 'multi_echo' WHEN 1 THEN 'multi_echo' WHEN 4 THEN 'multi_ti' WHEN 5 THEN 'multi_flip_angle' WHEN 6 THEN 'multi_coil' WHEN 9 THEN 'multi_coil' ELSE 'multi_stack' END
    WHEN kind = 1 THEN CASE what WHEN 2 THEN 'multi_parameter' ELSE 'multi_stack' END ELSE CASE WHEN what IN (0, 1) THEN 'multi_bed' ELSE 'multi_stack' END END END AS stack_key FROM s""",
    "stack_instance_counts": f"""
WITH {A.CTES}, s AS (SELECT DISTINCT series_id, image_type FROM instance), c AS (SELECT series_id, image_type, count(*) AS n FROM instance WHERE te >= 10 GROUP BY 1, 2)
SELECT series_id, image_type, coalesce(n, 0) AS stack_n_instances FROM s LEFT JOIN c USING (series_id, image_type)""",
    "stack_metrics": f"""
WITH {A.CTES}, s AS (SELECT series_id, image_type, min(fa) / 100 AS confidence FROM instance GROUP BY 1, 2),
g AS (SELECT series_id, count(*) AS n, min(confidence) AS low, sum(confidence) AS total, count(*) FILTER (confidence < 0.85::DOUBLE) AS n_low FROM s GROUP BY 1)
SELECT count(*) FILTER (n = 1) AS single, count(*) FILTER (n > 1) AS multi, max(n) AS most, min(low) AS least_confidence, CAST(sum(n_low) AS BIGINT) AS n_low,
    round(sum(total) / sum(n), 6) AS mean_confidence FROM g""",
    "first_instance_per_stack": f"WITH {A.CTES} SELECT DISTINCT ON (series_id, image_type) series_id, image_type, sop_uid, part_id, te FROM instance ORDER BY series_id, image_type, sop_uid, part_id, supplier_id, te, tr",
    "resume_filter": f"""
WITH {A.CTES}, r AS (SELECT DISTINCT sop_uid, series_id, concat_ws('/', study_id, instance_number) AS path FROM instance)
SELECT sop_uid, path FROM r WHERE sop_uid > '2' AND path NOT IN (SELECT path FROM r WHERE series_id % 5 = 0)""",
    "sister_series": f"""
WITH {A.CTES}, c AS (SELECT study_id, series_id, count(DISTINCT sop_uid) AS n_instances FROM instance GROUP BY 1, 2)
SELECT a.series_id, b.series_id AS sister_id, b.n_instances FROM c a JOIN c b ON a.study_id = b.study_id AND a.series_id <> b.series_id""",
    "middle_instance": f"""
WITH {A.CTES}, d AS (SELECT DISTINCT series_id, coalesce(ti, te) AS at_, sop_uid FROM instance),
n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY at_, sop_uid) AS r, count(*) OVER (PARTITION BY series_id) AS n FROM d)
SELECT series_id, sop_uid FROM n WHERE r = n // 2 + 1""",
    "import_subjects_upsert": """
WITH o AS (SELECT c_name AS subject_code, c_mktsegment AS segment, c_acctbal AS balance FROM customer WHERE c_custkey % 2 = 0),
i AS (SELECT c_name AS subject_code, CASE WHEN c_custkey % 6 <> 0 THEN upper(c_mktsegment) END AS segment, -c_acctbal AS balance FROM customer WHERE c_custkey % 3 = 0)
SELECT coalesce(i.subject_code, o.subject_code) AS subject_code, coalesce(i.segment, o.segment) AS segment, coalesce(i.balance, o.balance) AS balance
FROM o FULL JOIN i ON o.subject_code = i.subject_code""",
    "import_memberships_replace": f"""
WITH {A.CTES} SELECT subject_id, cohort_id FROM subject_cohort WHERE subject_id % 10 <> 0 UNION ALL SELECT subject_id, 4 FROM subject WHERE subject_id % 10 = 0""",
    "import_identifiers_replace": """
WITH o AS (SELECT c_custkey AS subject_id, c_mktsegment AS ov FROM customer WHERE c_custkey % 3 = 0),
n AS (SELECT c_custkey AS subject_id, CASE WHEN c_custkey % 4 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS nv FROM customer WHERE c_custkey % 2 = 0)
SELECT subject_id, coalesce(nv, ov) AS value, CASE WHEN nv IS NULL THEN 'kept' WHEN ov IS NULL THEN 'inserted' WHEN ov <> nv THEN 'updated' ELSE 'skipped' END AS action
FROM o FULL JOIN n USING (subject_id)""",
    "table_explorer_page": """
WITH f AS (SELECT * FROM customer WHERE lower(c_name) LIKE '%auto%' OR lower(c_mktsegment) LIKE '%auto%')
SELECT *, (SELECT count(*) FROM customer) AS total_rows, (SELECT count(*) FROM f) AS filtered_rows FROM f ORDER BY c_acctbal DESC, c_custkey LIMIT 25 OFFSET 10""",
    "archive_bin_packing_ffd": f"""{FFD} SELECT source, name, size, CAST(chunk - 1 AS INTEGER) AS chunk FROM p""",
    "archive_chunk_plan": f"""{FFD} SELECT source, chunk AS chunk_id, string_agg(name, ',' ORDER BY name) AS members, count(*) AS n_members, CAST(sum(size) AS BIGINT) AS total_bytes FROM p GROUP BY source, chunk""",
    "archive_bin_packing": """
WITH RECURSIVE n AS (SELECT source, doc_id AS name, n_chars AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents),
p AS (SELECT source, name, size, r, size AS held, 0 AS chunk FROM n WHERE r = 1
    UNION ALL SELECT n.source, n.name, n.size, n.r, CASE WHEN p.held + n.size > 50000 THEN n.size ELSE p.held + n.size END, CASE WHEN p.held + n.size > 50000 THEN p.chunk + 1 ELSE p.chunk END
    FROM p JOIN n ON n.source IS NOT DISTINCT FROM p.source AND n.r = p.r + 1)
SELECT source, name, size, CAST(chunk AS INTEGER) AS chunk FROM p""",
}
