"""Imports of CSV files and de-identification plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom.operators import identity as I
from stackloom.operators import imports as M


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rows of a subject file, texts as a CSV has them: blanks, bad dates, repeats."""
    k = F.col("o_orderkey")
    return _orders(spark, sf_dir).select(
        k.alias("row_number"),
        F.when(k % 37 == 0, "  ").otherwise(F.concat(F.lit(" Customer"), F.col("o_custkey"), F.lit(" "))).alias("code"),
        F.when(k % 5 == 0, "31/02/1999").when(k % 5 == 1, "").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("born"),
        F.when(k % 4 == 0, "no").when(k % 4 == 1, "2.5").when(k % 4 == 2, "perhaps").alias("active"),
        F.when(k % 3 == 0, "12x").otherwise(k.cast("string")).alias("weight"),
    )


_FIELDS = [M.Field("subject_code", "code"), M.Field("birth_date", "born", parser="date"), M.Field("is_active", "active", "yes", "bool"), M.Field("weight", "weight", parser="int"), M.Field("site", default=" Lund ")]


def import_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of a file coerced, with what it is warned of."""
    return M.coerced(_rows(spark, sf_dir), _FIELDS).withColumn("warnings", F.array_join("warnings", "; "))


def import_dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What importing a file would do to the subjects: the last row of a code counts, blanks do
    not overwrite (I1, I6)."""
    incoming = M.last_rows(M.coerced(_rows(spark, sf_dir), _FIELDS), "subject_code")
    known = _customers(spark, sf_dir).filter("c_custkey % 2 = 0").select(F.concat(F.lit("Customer"), "c_custkey").alias("subject_code"), F.lit(None).cast("date").alias("birth_date"), F.lit(1).alias("is_active"))
    return M.import_plan(known, incoming, "subject_code", ["birth_date", "is_active"])


def import_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohorts by lower-case name, in the spelling of their first row."""
    name = F.when(F.col("c_custkey") % 2 == 0, F.initcap("c_mktsegment")).otherwise(F.concat(F.lit(" "), "c_mktsegment"))
    return M.cohort_rows(_customers(spark, sf_dir).select(F.col("c_custkey").alias("row_number"), name.alias("name")))


def anonymise_sequential_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patients numbered by their first study."""
    found = _orders(spark, sf_dir).select(F.concat(F.lit("P"), "o_custkey").alias("patient_id"), F.col("o_orderkey").alias("at"))
    return I.sequential_ids(found, "patient_id", "at", "STUDYXXXX")


def anonymise_hash_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapped ids, and salted hashes for the others."""
    customers = _customers(spark, sf_dir).select(F.col("c_name").alias("patient_id"), "c_custkey")
    mapping = customers.filter("c_custkey % 3 = 0").select(F.concat(F.lit(" "), "patient_id").alias("old_id"), F.concat(F.lit("M"), "c_custkey").alias("new_id"))
    return I.mapped_ids(customers, mapping, "patient_id", I.deterministic_id(F.col("patient_id"), "SXXXXXX", "salt")).select("patient_id", "new_id")


def anonymise_path_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids from a folder's name: its number, or its text."""
    path = F.concat_ws("/", F.lit("raw"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("sub-"), "c_mktsegment")).otherwise(F.concat(F.lit("pat_"), F.col("c_custkey") % 10007)), F.lit("a.dcm"))
    path = F.when(F.col("c_custkey") % 50 == 0, "raw").otherwise(path)
    return _customers(spark, sf_dir).select("c_custkey", I.path_id(path, 2, "^pat_([0-9]+)$", "IDXXXX").alias("new_id"))


def subject_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject codes from a mapping, else keyed hashes of patient or study (F8, S8): how many of each."""
    patient = F.when(F.col("o_custkey") % 10 == 0, None).otherwise(F.concat(F.lit("P"), "o_custkey"))
    rows = _orders(spark, sf_dir).select(patient.alias("patient_id"), F.concat(F.lit("1.2."), "o_orderkey").alias("study_uid"))
    mapping = _customers(spark, sf_dir).filter("c_custkey % 4 = 1").select(F.concat(F.lit("P"), "c_custkey").alias("old_id"), F.concat(F.lit("C"), "c_custkey").alias("new_id"))
    found = I.resolved_subjects(rows, mapping, "seed")
    return found.groupBy("source", F.length("subject_code").alias("code_length")).agg(F.count("*").alias("n"), F.count_distinct("subject_code").alias("n_codes"))


def subject_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code of every study, where a mapping has one, and whether the others got a hash."""
    patient = F.when(F.col("o_custkey") % 10 == 0, " ").when(F.col("o_custkey") % 10 == 5, None).otherwise(F.concat(F.lit("P"), "o_custkey"))
    rows = _orders(spark, sf_dir).select(F.nullif(F.trim(patient), F.lit("")).alias("patient_id"), F.concat(F.lit("1.2."), "o_orderkey").alias("study_uid"))
    entry = _customers(spark, sf_dir).filter("c_custkey % 4 = 1").select(F.concat(F.lit(" P"), "c_custkey").alias("old_id"), F.concat("c_mktsegment", F.lit("-"), "c_custkey", F.lit(" ")).alias("new_id"))
    found = I.resolved_subjects(rows, entry.union(entry.filter("old_id < ' P2'")), "seed")
    return found.select("study_uid", "source", F.when(F.col("source") == "csv", F.col("subject_code")).alias("mapped_code"), F.col("subject_code").rlike("^[0-9a-f]{16}$").alias("hashed"))


def subject_mapping_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mapping file must be rejected for."""
    k = F.col("o_custkey")
    code = F.when(k % 7 == 0, F.concat(F.lit("C"), F.col("o_orderkey") % 2)).when((k % 11 == 0) & (F.col("o_orderkey") % 3 == 0), " ").otherwise(F.concat(F.lit(" C"), k))
    mapping = _orders(spark, sf_dir).select(F.when(k % 13 == 0, F.lit("  ")).otherwise(F.concat(F.lit("P"), k, F.lit(" "))).alias("old_id"), F.when(k % 17 != 0, code).alias("new_id"))
    return I.mapping_problems(mapping)


_TAGS = ("0010,0010", "0010,0020", "0008,0018", "0008,1140", "0008,0080", "0018,0050")
_NAMES = ("PatientName", "PatientID", "SOPInstanceUID", "ReferencedImageSequence", "InstitutionName", "SliceThickness")


def scrub_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What happens to the tags of each file."""
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("event_id") % 6 + 1).cast("int"))
    tags = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("f"), "user_id").alias("path"), pick(_TAGS).alias("tag"), pick(_NAMES).alias("name"), F.col("event_type").alias("value"))
    scrubbed = spark.createDataFrame([(t,) for t in _TAGS[:5]] + [(_TAGS[0],)], "tag string")
    return I.scrub_plan(tags, scrubbed, ("0010,0020",)).groupBy("path", "tag", "action").agg(F.count("*").alias("n"), F.min("old_value").alias("first_value"))


def discovered_patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patients that each way of looking finds."""
    k = F.col("o_orderkey")
    files = _orders(spark, sf_dir).select(F.concat_ws("/", F.concat(F.lit("top"), F.col("o_custkey") % 40), F.lpad(k.cast("string"), 9, "0")).alias("path"), F.when(k % 7 != 0, F.concat(F.lit("u"), F.floor(k / 8))).alias("study_uid"), F.when(k % 5 != 0, F.concat(F.lit("P"), "o_custkey")).alias("patient_id"))
    parts = [I.discovered_ids(files, m).withColumn("mode", F.lit(m)) for m in ("top", "study", "all")]
    return parts[0].union(parts[1]).union(parts[2])


def deidentification_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replaced, retained and removed elements of each file."""
    k = F.col("o_orderkey")
    patient = F.when(F.col("o_custkey") % 5 != 0, F.concat(F.lit("P"), "o_custkey")).otherwise("")
    date = F.when(k % 7 == 0, "unknown").when(k % 7 != 1, F.date_format("o_orderdate", "yyyyMMdd"))
    cells = (("0010,0020", "PatientID", patient), ("0008,0020", "StudyDate", date), ("0020,000D", "StudyInstanceUID", F.concat(F.lit("1."), k)), ("0010,0010", "PatientName", F.lit("N")), ("0008,0018", "SOPInstanceUID", F.lit("1")),
             ("0008,1010", "StationName", F.col("o_orderstatus")), ("0018,0050", "SliceThickness", F.lit("2")), ("0008,0090", "ReferringPhysicianName", F.lit("R")))
    element = F.explode(F.array(*(F.struct(F.lit(t).alias("tag"), F.lit(n).alias("name"), v.cast("string").alias("value")) for t, n, v in cells))).alias("e")
    tags = _orders(spark, sf_dir).select(F.concat(F.lit("f"), k).alias("path"), element).select("path", "e.*")
    ids = _customers(spark, sf_dir).filter("c_custkey % 2 = 0").select(F.concat(F.lit(" P"), "c_custkey").alias("old_id"), F.concat(F.lit("S"), "c_custkey").alias("new_id"))
    return I.audit_events(tags, ids, ("Patient_Information", "Institution_Information", "Healthcare_Provider_Information"), kept=("0008,0090",))


_ALL = (import_coercion, import_dry_run, import_cohorts, anonymise_sequential_ids, anonymise_hash_ids, anonymise_path_ids, subject_resolution, subject_codes, subject_mapping_problems, scrub_tags, deidentification_events, discovered_patients)
QUERIES = {f.__name__: f for f in _ALL}

_IN = """i AS (SELECT o_orderkey AS row_number, CASE WHEN o_orderkey % 37 <> 0 THEN 'Customer' || o_custkey END AS subject_code, CASE WHEN o_orderkey % 5 > 1 THEN CAST(o_orderdate AS DATE) END AS birth_date,
    [0, 1, NULL, 1][o_orderkey % 4 + 1] AS is_active, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey END AS weight, 'Lund' AS site FROM orders)"""
_FILES = """f AS (SELECT 'top' || (o_custkey % 40) AS top, 'top' || (o_custkey % 40) || '/' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS path, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey // 8 END AS u, 'P' || o_custkey AS p FROM orders WHERE o_orderkey % 5 <> 0)"""

ORACLE_SQL = {
    "import_coercion": f"""WITH {_IN} SELECT *, concat_ws('; ', CASE WHEN row_number % 5 = 0 THEN 'Row ' || row_number || ': cannot parse birth_date' END,
    CASE WHEN row_number % 4 = 2 THEN 'Row ' || row_number || ': cannot parse is_active' END, CASE WHEN row_number % 3 = 0 THEN 'Row ' || row_number || ': cannot parse weight' END) AS warnings FROM i""",
    "import_dry_run": f"""WITH {_IN}, l AS (SELECT DISTINCT ON (subject_code) subject_code, birth_date, is_active FROM i WHERE subject_code IS NOT NULL ORDER BY subject_code, row_number DESC),
k AS (SELECT 'Customer' || c_custkey AS subject_code, 1 AS was FROM customer WHERE c_custkey % 2 = 0)
SELECT subject_code, CASE WHEN was IS NULL THEN 'inserted' WHEN birth_date IS NOT NULL OR is_active = 0 THEN 'updated' ELSE 'skipped' END AS action, birth_date, coalesce(is_active, was) AS is_active FROM l LEFT JOIN k USING (subject_code)""",
    "import_cohorts": "SELECT lower(c_mktsegment) AS key, CASE WHEN min(c_custkey) % 2 = 0 THEN upper(lower(c_mktsegment)[1]) || lower(c_mktsegment)[2:] ELSE upper(lower(c_mktsegment)) END AS name FROM customer GROUP BY c_mktsegment",
    "anonymise_sequential_ids": "SELECT 'P' || o_custkey AS patient_id, 'STUDY' || CASE WHEN n > 9999 THEN CAST(n AS VARCHAR) ELSE lpad(CAST(n AS VARCHAR), 4, '0') END AS new_id FROM (SELECT o_custkey, row_number() OVER (ORDER BY min(o_orderkey), 'P' || o_custkey) AS n FROM orders GROUP BY o_custkey)",
    "anonymise_path_ids": "SELECT c_custkey, CASE WHEN c_custkey % 50 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 'IDsub-' || c_mktsegment ELSE 'ID' || CASE WHEN c_custkey % 10007 > 9999 THEN CAST(c_custkey % 10007 AS VARCHAR) ELSE lpad(CAST(c_custkey % 10007 AS VARCHAR), 4, '0') END END AS new_id FROM customer",
    "subject_codes": """
WITH x AS (SELECT '1.2.' || o_orderkey AS study_uid, o_custkey % 10 NOT IN (0, 5) AND o_custkey % 4 = 1 AS known, o_custkey FROM orders)
SELECT study_uid, CASE WHEN known THEN 'csv' ELSE 'hash' END AS source, CASE WHEN known THEN c_mktsegment || '-' || c_custkey END AS mapped_code, NOT known AS hashed FROM x JOIN customer ON c_custkey = o_custkey""",
    "subject_mapping_problems": """
WITH x AS (SELECT CASE WHEN o_custkey % 13 <> 0 THEN 'P' || o_custkey ELSE '' END AS id, CASE WHEN o_custkey % 17 = 0 THEN '' WHEN o_custkey % 7 = 0 THEN 'C' || (o_orderkey % 2)
    WHEN o_custkey % 11 = 0 AND o_orderkey % 3 = 0 THEN '' ELSE 'C' || o_custkey END AS code FROM orders)
SELECT 'conflict' AS problem, id FROM x WHERE id <> '' AND code <> '' GROUP BY id HAVING count(DISTINCT code) > 1
UNION ALL SELECT DISTINCT 'code_missing', id FROM x WHERE id <> '' AND code = '' UNION ALL SELECT DISTINCT 'id_missing', code FROM x WHERE id = '' AND code <> ''""",
    "subject_resolution": """SELECT CASE WHEN o_custkey % 10 <> 0 AND o_custkey % 4 = 1 THEN 'csv' ELSE 'hash' END AS source, CAST(CASE WHEN o_custkey % 10 <> 0 AND o_custkey % 4 = 1 THEN length('C' || o_custkey) ELSE 16 END AS INTEGER) AS code_length,
    count(*) AS n, count(DISTINCT CASE WHEN o_custkey % 10 = 0 THEN -o_orderkey ELSE o_custkey END) AS n_codes FROM orders GROUP BY ALL""",
    "scrub_tags": """SELECT 'f' || user_id AS path, ['0010,0010', '0010,0020', '0008,0018', '0008,1140', '0008,0080'][event_id % 6 + 1] AS tag, CASE WHEN event_id % 6 IN (0, 4) THEN 'removed' ELSE 'retained' END AS action,
    count(*) AS n, min(event_type) AS first_value FROM events WHERE event_id % 6 <> 5 GROUP BY ALL""",
    "deidentification_events": """WITH f AS (SELECT 'f' || o_orderkey AS path, '1.' || o_orderkey AS study_uid, CASE WHEN o_custkey % 5 <> 0 THEN 'P' || o_custkey END AS p, o_custkey AS c, CASE WHEN o_orderkey % 7 = 0 THEN 'unknown' WHEN o_orderkey % 7 <> 1 THEN strftime(o_orderdate, '%Y%m%d') END AS d,
    CASE WHEN o_orderkey % 7 > 1 THEN CAST(o_orderdate AS DATE) END AS day, o_orderstatus AS station FROM orders),
g AS (SELECT *, CASE WHEN p IS NOT NULL THEN min(day) OVER (PARTITION BY p) END AS first FROM f),
m AS (SELECT *, CASE WHEN first IS NULL OR day IS NULL THEN NULL ELSE datediff('month', first, day) - CASE WHEN first + to_months(CAST(datediff('month', first, day) AS INTEGER)) > day THEN 1 ELSE 0 END END AS whole FROM g),
n AS (SELECT *, CAST(round_even(whole + datediff('day', CAST(first + to_months(CAST(whole AS INTEGER)) AS DATE), day) / 30.44::DOUBLE, 0) AS INTEGER) AS months FROM m),
t AS (SELECT *, greatest(6, CAST(6 * round_even(months / 6.0::DOUBLE, 0) AS INTEGER)) AS six FROM n),
l AS (SELECT *, CASE WHEN months = 0 THEN 'M00' ELSE 'M' || CASE WHEN CASE WHEN abs(months - six) <= 1 THEN six ELSE months END > 9 THEN '' ELSE '0' END || CASE WHEN abs(months - six) <= 1 THEN six ELSE months END END AS label FROM t)
SELECT path, study_uid, '0010,0020' AS tag, 'PatientID' AS name, 'replaced' AS action, p AS old_value, 'S' || c AS new_value FROM l WHERE p IS NOT NULL AND c % 2 = 0 AND c IN (SELECT c_custkey FROM customer)
UNION ALL SELECT path, study_uid, '0008,0020', 'StudyDate', CASE WHEN label IS NULL THEN 'retained' ELSE 'replaced' END, d, coalesce(label, '') FROM l WHERE d IS NOT NULL
UNION ALL SELECT path, study_uid, '0010,0010', 'PatientName', 'removed', 'N', '' FROM l UNION ALL SELECT path, study_uid, '0008,1010', 'StationName', 'removed', station, '' FROM l""",
    "discovered_patients": f"""WITH {_FILES} SELECT DISTINCT p AS patient_id, 'top' AS mode FROM (SELECT min_by(p, path) AS p FROM f GROUP BY top)
UNION ALL SELECT DISTINCT p, 'study' FROM (SELECT min_by(p, path) AS p FROM f WHERE u IS NOT NULL GROUP BY u) UNION ALL SELECT DISTINCT p, 'all' FROM f""",
}
