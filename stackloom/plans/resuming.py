"""Runs that resume, folders that are renamed, counts that are patched, items that change status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom.operators import flow as W
from stackloom.operators import resume as R
from stackloom.operators import review
from stackloom.sources import adapter as A


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def leaf_resume_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a resumed run does with each file: process in full, only write, or skip."""
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    path = F.concat_ws("/", F.lit("in"), "l_orderkey", "l_linenumber")
    files = lines.select(F.concat_ws("/", F.lit("in"), "l_orderkey").alias("leaf"), path.alias("path"), F.concat_ws("/", F.lit("out"), "l_orderkey", "l_linenumber").alias("output"), F.when((F.col("l_linenumber") + F.col("l_orderkey")) % 3 != 0, F.concat(F.lit("t"), F.floor(F.col("l_orderkey") / 3))).alias("study_uid"))
    audited = _table(spark, sf_dir, "orders").filter("o_custkey % 4 = 0").select(F.concat(F.lit("t"), F.floor(F.col("o_orderkey") / 3)).alias("study_uid"))
    outputs = lines.filter("(l_orderkey + l_linenumber) % 5 < 3").select(F.concat_ws("/", F.lit("out"), "l_orderkey", "l_linenumber").alias("path"))
    return R.leaf_modes(files, audited, outputs)


def leaf_resume_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by mode for each leaf."""
    return R.leaf_summary(leaf_resume_modes(spark, sf_dir))


def _folders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Three levels of folders named after patients, and what two in seven patients become."""
    rows = _table(spark, sf_dir, "customer").select("c_custkey")
    k = F.col("c_custkey")
    levels = F.array(F.concat(F.lit("top"), k % 10), F.concat(F.lit("pat_"), k), F.when(k % 4 == 0, F.concat(F.lit("x_pat_"), k, F.lit("_pat_"), k % 50)).otherwise(F.concat(F.lit("scan"), k % 3)))
    folders = rows.select(F.explode(F.sequence(F.lit(1), F.lit(3))).alias("n"), levels.alias("l")).select(F.array_join(F.slice("l", F.lit(1), F.col("n")), "/").alias("path")).distinct()
    some = rows.filter("c_custkey % 70 = 1").select(F.concat(F.lit("top"), k % 10, F.lit("/ID"), k).alias("path"))  # names that are taken
    mapping = rows.filter("c_custkey % 7 < 2").select(F.concat(F.lit("pat_"), k).alias("old"), F.concat(F.lit("ID"), k).alias("new"))
    return folders.union(some), mapping


def rename_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders that a run renames, the deepest first, and those whose new name is taken."""
    return R.rename_plan(*_folders(spark, sf_dir))


def renamed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a file of each folder lies after the renaming."""
    folders, mapping = _folders(spark, sf_dir)
    return R.renamed_paths(folders.select(F.concat("path", F.lit("/f.dcm")).alias("path")), R.rename_plan(folders, mapping))


def approximate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of tables, stored ones where they can be trusted (A2)."""
    sizes = {t: _table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem", "part", "supplier", "nation")}
    kinds = _table(spark, sf_dir, "nation").filter("n_nationkey < 12").select("n_nationkey", (F.col("n_nationkey") % 6).alias("t"), F.floor(F.col("n_nationkey") / 6).alias("again"))
    name = F.element_at(F.array(*map(F.lit, sizes)), (F.col("t") + 1).cast("int"))
    stats = kinds.select(
        name.alias("name"), F.when(F.col("again") == 0, 1_000_000 + F.col("t")).otherwise(F.col("t")).alias("estimate"), F.when(F.col("t") == 1, 2_000_000).otherwise(1_000_000).alias("live"),
        F.when(F.col("t") == 2, 300_000).otherwise(0).alias("modified"), F.when(F.col("t") != 3, "2020-01-01").alias("analysed"),
    )
    first = stats.filter("estimate >= 1000000")
    small = stats.filter("estimate < 1000000").withColumn("name", F.concat("name", F.lit("_small")))
    return W.approximate_counts(first.union(small), {**sizes, **{f"{t}_small": d for t, d in sizes.items()}})


def patched_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored metrics of a cohort after dates were recovered, without a recount."""
    studies, series = A.studies(spark, sf_dir), A.instances(spark, sf_dir).select("series_id", "study_id").distinct()
    series = series.join(studies.select("study_id", "modality"), "study_id")
    dated = studies.filter("study_date IS NOT NULL")
    of_dated = series.filter("modality IN ('MR', 'CT', 'PT')").join(dated.select("study_id"), "study_id", "left_semi")
    named = lambda rows, metric: rows.agg(F.count("*").alias("value")).select(F.lit(metric).alias("metric"), "value")
    stored = named(dated, "studies_with_valid_date").union(named(studies.filter("study_date IS NULL"), "studies_excluded_no_date")).union(named(of_dated, "total_series")).union(named(of_dated, "series_to_process_count"))
    stored = stored.union(of_dated.groupBy(F.concat(F.lit("series_by_modality:"), "modality").alias("metric")).agg(F.count("*").alias("value")))
    shipped = _table(spark, sf_dir, "lineitem").filter("l_linenumber <= 2").select(F.col("l_orderkey").alias("study_id"), F.to_date("l_shipdate").alias("d"), F.when(F.col("l_linenumber") == 2, F.date_add(F.to_date("l_shipdate"), 400)).alias("e"))
    found = review.recovered_date(shipped, "study_id", [F.col("e"), F.col("d")]).select("study_id", "recovered", F.concat(F.lit("source "), "source_rank").alias("source"))
    return W.patched_metrics(stored, W.recovery(studies, found, 1993, 1997), series)


def date_recovery_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Studies without a date, the date that was found and the note about it."""
    shipped = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("study_id"), F.to_date("l_shipdate").alias("recovered"), F.when(F.col("l_linenumber") % 2 == 0, "series UID").otherwise("study UID").alias("source"))
    return W.recovery(A.studies(spark, sf_dir), shipped, 1993, 1997)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, ("reviewed", "confirmed", "skipped", "pending", "reviewed", "archived"))), ((F.col("l_partkey") + F.col("l_linenumber")) % 6 + 1).cast("int"))
    return _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.to_date("l_shipdate").alias("at"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("seq"), status.alias("status"))


def item_status_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the review of each item stands after all events, and which events were not allowed (Q22)."""
    return W.item_status(_events(spark, sf_dir))


def draft_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts left after sets and discards (Q16)."""
    k = F.col("l_partkey") + F.col("l_linenumber")
    field = F.when(k % 2 == 0, "base").otherwise("technique")
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.to_date("l_shipdate").alias("at"), (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey")).cast("long").alias("seq"), F.when(k % 5 == 0, "discard").otherwise("set").alias("kind"), F.when(k % 15 != 0, field).alias("field"), F.concat(F.lit("v"), "l_suppkey").alias("new_value"))
    before = _table(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("item_id"), F.lit("base").alias("field"), F.lit("old").alias("new_value"))
    return W.draft_changes(before, lines)


def item_confirm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classifications after the drafts of general items are pushed (Q17)."""
    orders = _table(spark, sf_dir, "orders")
    cache = orders.select(F.col("o_orderkey").alias("series_id"), F.lit("T1w").alias("base"), F.lit(0).alias("post_contrast"), F.lit(1).alias("review_required"))
    k = F.col("o_orderkey")
    drafts = orders.filter("o_orderkey % 4 <> 3").select(k.alias("series_id"), F.when(k % 4 == 0, "base").when(k % 4 == 1, "post_contrast").otherwise("comment").alias("field"), F.when(k % 8 == 1, "").when(k % 4 == 1, "1").otherwise("T2w").alias("new_value"))
    return W.confirm_item_changes(cache, drafts, ("base", "post_contrast"))


_ALL = (leaf_resume_modes, leaf_resume_summary, rename_plan, renamed_files, approximate_counts, patched_metrics, date_recovery_notes, item_status_flow, draft_flow, item_confirm)
QUERIES = {f.__name__: f for f in _ALL}

_MODES = """WITH f AS (SELECT DISTINCT 'in/' || l_orderkey AS leaf, 'in/' || l_orderkey || '/' || l_linenumber AS path, CASE WHEN (l_linenumber + l_orderkey) % 3 <> 0 THEN 't' || (l_orderkey // 3) END AS own, (l_orderkey + l_linenumber) % 5 < 3 AS there FROM lineitem),
n AS (SELECT *, first_value(own IGNORE NULLS) OVER (PARTITION BY leaf ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS study_uid, row_number() OVER (PARTITION BY leaf ORDER BY path) AS r FROM f),
a AS (SELECT n.*, study_uid IS NOT NULL AND study_uid IN (SELECT 't' || (o_orderkey // 3) FROM orders WHERE o_custkey % 4 = 0) AS audit_done FROM n),
m AS (SELECT leaf, path, study_uid, audit_done, CASE WHEN NOT audit_done AND r = 1 THEN 'full' WHEN there THEN 'skip' ELSE 'output_only' END AS mode FROM a)"""
_FOLDERS = """l AS (SELECT c_custkey AS k, ['top' || (c_custkey % 10), 'pat_' || c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'x_pat_' || c_custkey || '_pat_' || (c_custkey % 50) ELSE 'scan' || (c_custkey % 3) END] AS l FROM customer),
d AS (SELECT DISTINCT array_to_string(l[1:n], '/') AS path FROM l, range(1, 4) AS t(n) UNION ALL SELECT 'top' || (c_custkey % 10) || '/ID' || c_custkey FROM customer WHERE c_custkey % 70 = 1),
p AS (SELECT path, string_split(path, '/') AS s FROM (SELECT DISTINCT path FROM d)), q AS (SELECT path, CAST(len(s) AS INTEGER) AS depth, s[-1] AS name, array_to_string(s[:-2], '/') AS parent FROM p),
m AS (SELECT 'pat_' || c_custkey AS old, 'ID' || c_custkey AS new, row_number() OVER (ORDER BY -length('pat_' || c_custkey), 'pat_' || c_custkey) AS rank FROM customer WHERE c_custkey % 7 < 2),
r AS (SELECT DISTINCT name, name AS cur, 0::BIGINT AS rank FROM q
    UNION ALL SELECT x.name, replace(x.cur, m.old, m.new), m.rank FROM (SELECT r.name, r.cur, min(m.rank) AS nr FROM r JOIN m ON m.rank > r.rank AND contains(r.cur, m.old) GROUP BY ALL) x JOIN m ON m.rank = x.nr),
e AS (SELECT name, arg_max(cur, rank) AS new_name FROM r GROUP BY name HAVING max(rank) > 0),
c AS (SELECT q.path, depth, parent, q.name, new_name FROM q JOIN e USING (name) WHERE new_name <> q.name),
plan AS (SELECT path, depth, new_name, CASE WHEN EXISTS (FROM q WHERE q.parent = c.parent AND q.name = c.new_name) OR name <> min(name) OVER (PARTITION BY parent, new_name) THEN 'target exists' ELSE 'rename' END AS status FROM c)"""
_DATES = "t AS (SELECT o_orderkey AS study_id, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderdate AS DATE) END AS study_date, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'MR' WHEN '2' THEN 'MR' WHEN '3' THEN 'CT' WHEN '4' THEN 'PT' ELSE 'OT' END AS modality FROM orders)"

ORACLE_SQL = {
    "leaf_resume_modes": f"{_MODES} SELECT * FROM m",
    "leaf_resume_summary": f"{_MODES} SELECT leaf, count(*) AS n_files, count(*) FILTER (mode = 'full') AS n_full, count(*) FILTER (mode = 'output_only') AS n_output_only, count(*) FILTER (mode = 'skip') AS n_skip, bool_or(audit_done) AS leaf_skipped FROM m GROUP BY leaf",
    "rename_plan": f"WITH RECURSIVE {_FOLDERS} SELECT * FROM plan",
    "renamed_files": f"""WITH RECURSIVE {_FOLDERS}, i AS (SELECT path, unnest(range(1, len(s) + 1)) AS n, s FROM (SELECT path, string_split(path, '/') AS s FROM (SELECT DISTINCT path FROM d)))
SELECT i.path || '/f.dcm' AS path, string_agg(coalesce(new_name, s[n]), '/' ORDER BY n) || '/f.dcm' AS new_path FROM i LEFT JOIN plan ON plan.path = array_to_string(s[1:n], '/') AND status = 'rename' GROUP BY i.path""",
    "approximate_counts": """SELECT 'customer' AS name, 1000000 AS n, false AS counted UNION ALL SELECT 'orders', (SELECT count(*) FROM orders), true UNION ALL SELECT 'lineitem', (SELECT count(*) FROM lineitem), true UNION ALL SELECT 'part', (SELECT count(*) FROM part), true
UNION ALL SELECT 'supplier', 1000004, false UNION ALL SELECT 'nation', 1000005, false UNION ALL SELECT 'customer_small', (SELECT count(*) FROM customer), true UNION ALL SELECT 'orders_small', (SELECT count(*) FROM orders), true
UNION ALL SELECT 'lineitem_small', (SELECT count(*) FROM lineitem), true UNION ALL SELECT 'part_small', (SELECT count(*) FROM part), true UNION ALL SELECT 'supplier_small', (SELECT count(*) FROM supplier), true UNION ALL SELECT 'nation_small', (SELECT count(*) FROM nation), true""",
    "patched_metrics": f"""WITH {_DATES},
s AS (SELECT DISTINCT l_orderkey * 3 + l_suppkey % 3 AS series_id, l_orderkey AS study_id FROM lineitem),
g AS (SELECT l_orderkey AS study_id, coalesce(min(CASE WHEN l_linenumber = 2 THEN CAST(l_shipdate AS DATE) + 400 END), min(CAST(l_shipdate AS DATE))) AS d FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1),
n AS (SELECT t.study_id, modality, study_date IS NOT NULL OR coalesce(year(d) BETWEEN 1993 AND 1997, false) AS dated FROM t LEFT JOIN g USING (study_id)), -- all counted anew
x AS (SELECT modality FROM s JOIN n USING (study_id) WHERE dated AND modality <> 'OT')
SELECT 'studies_with_valid_date' AS metric, count(*) FILTER (dated) AS value FROM n UNION ALL SELECT 'studies_excluded_no_date', count(*) FILTER (NOT dated) FROM n UNION ALL SELECT 'total_series', count(*) FROM x
UNION ALL SELECT 'series_to_process_count', count(*) FROM x UNION ALL SELECT 'series_by_modality:' || modality, count(*) FROM x GROUP BY modality""",
    "date_recovery_notes": f"""WITH {_DATES}, g AS (SELECT l_orderkey AS study_id, CASE WHEN l_linenumber % 2 = 0 THEN 'series UID' ELSE 'study UID' END AS source, CAST(l_shipdate AS DATE) AS d FROM lineitem WHERE year(CAST(l_shipdate AS DATE)) BETWEEN 1993 AND 1997),
b AS (SELECT study_id, min((source, d)) AS r FROM g GROUP BY 1)
SELECT t.study_id, r[2] AS study_date, 'study_date recovered from ' || r[1] || ' (year range 1993-1997)' AS quality_control FROM t LEFT JOIN b USING (study_id) WHERE t.study_date IS NULL""",
    "item_status_flow": """WITH RECURSIVE e AS (SELECT l_orderkey AS item_id, CAST(l_shipdate AS DATE) AS at_, ['reviewed', 'confirmed', 'skipped', 'pending', 'reviewed', 'archived'][(l_partkey + l_linenumber) % 6 + 1] AS status,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(l_shipdate AS DATE), l_linenumber, l_partkey, l_suppkey) AS r, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
ok(old, new) AS (VALUES ('pending', 'reviewed'), ('pending', 'confirmed'), ('pending', 'skipped'), ('reviewed', 'confirmed'), ('reviewed', 'skipped'), ('reviewed', 'pending'), ('confirmed', 'pending'), ('skipped', 'pending')),
f AS (SELECT DISTINCT item_id, 0::BIGINT AS r, n, 'pending' AS status, NULL::DATE AS reviewed_at, NULL::DATE AS confirmed_at, ''::VARCHAR AS illegal FROM e
    UNION ALL SELECT f.item_id, e.r, f.n, CASE WHEN ok.old IS NOT NULL THEN e.status ELSE f.status END, CASE WHEN ok.old IS NOT NULL AND e.status = 'reviewed' THEN e.at_ ELSE f.reviewed_at END,
        CASE WHEN ok.old IS NOT NULL AND e.status = 'confirmed' THEN e.at_ ELSE f.confirmed_at END, CASE WHEN ok.old IS NOT NULL OR e.status = f.status THEN f.illegal ELSE f.illegal || CASE WHEN f.illegal = '' THEN '' ELSE ',' END || f.status || '>' || e.status END
    FROM f JOIN e ON e.item_id = f.item_id AND e.r = f.r + 1 LEFT JOIN ok ON ok.old = f.status AND ok.new = e.status)
SELECT item_id, status, reviewed_at, confirmed_at, CAST(n AS INTEGER) AS n_events, illegal FROM f WHERE r = n""",
    "draft_flow": """WITH a AS (SELECT l_orderkey AS item_id, (CAST(l_shipdate AS DATE), l_linenumber::BIGINT * 1000000000 + l_partkey * 10000 + l_suppkey) AS o, l_partkey + l_linenumber AS k, CASE WHEN (l_partkey + l_linenumber) % 2 = 0 THEN 'base' ELSE 'technique' END AS f, 'v' || l_suppkey AS v FROM lineitem),
s AS (SELECT item_id, f AS field, o, v FROM a WHERE k % 5 <> 0 UNION ALL SELECT o_orderkey, 'base', NULL, 'old' FROM orders WHERE o_orderkey % 3 = 0),
l AS (SELECT item_id, field, max(o) AS o, coalesce(arg_max(v, (o, v)) FILTER (o IS NOT NULL), any_value(v)) AS v FROM s GROUP BY 1, 2)
SELECT item_id, field, v AS new_value FROM l WHERE NOT EXISTS (FROM a WHERE a.item_id = l.item_id AND a.k % 5 = 0 AND (a.k % 15 = 0 OR a.f = l.field) AND (l.o IS NULL OR a.o > l.o))""",
    "item_confirm": """SELECT o_orderkey AS series_id, CASE WHEN o_orderkey % 4 = 0 THEN 'T2w' ELSE 'T1w' END AS base, CASE WHEN o_orderkey % 8 = 1 THEN NULL WHEN o_orderkey % 4 = 1 THEN 1 ELSE 0 END AS post_contrast, CASE WHEN o_orderkey % 4 < 2 THEN 0 ELSE 1 END AS review_required FROM orders""",
}
