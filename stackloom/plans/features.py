"""Features of stacks: text, geometry, dates, bins and gap filling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom.functions import csvset as C
from stackloom.functions import dicom as D
from stackloom.functions import geometry as G
from stackloom.functions import text as T
from stackloom.operators import gapfill
from stackloom.sources import adapter as A


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def date_from_uid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The date inside a study's UID."""
    uid = F.concat(F.lit("1.2.840."), F.col("o_orderkey"), F.lit("."), F.date_format("o_orderdate", "yyyyMMdd"))
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("study_id"), D.date_in_uid(uid).alias("recovered"))


def orientation_from_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plane and confidence from the first six components."""
    plane, confidence = G.orientation(F.col("embedding"))
    return _table(spark, sf_dir, "embeddings").select("vec_id", plane.alias("orientation"), F.round(confidence, 6).alias("confidence"))


def fingerprint_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide row of each instance: study, subject and device beside it."""
    part = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_id"), F.col("p_type").alias("scanning_sequence"), F.col("p_size").alias("matrix"))
    maker = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("supplier_id"), F.col("s_name").alias("manufacturer"))
    first = A.instances(spark, sf_dir).groupBy("series_id", "image_type").agg(F.min(F.struct("sop_uid", "part_id", "supplier_id", "te", "tr", "study_id")).alias("r")).select("series_id", "image_type", "r.*")
    wide = first.join(A.studies(spark, sf_dir), "study_id").join(A.subjects(spark, sf_dir), "subject_id").join(part, "part_id", "left").join(maker, "supplier_id", "left")
    return wide.select("series_id", "image_type", "sop_uid", "te", "tr", "modality", "study_date", "subject_code", "scanning_sequence", "matrix", "manufacturer")


def fingerprint_fov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field of view and aspect from spacing text (F16)."""
    part = _table(spark, sf_dir, "part")
    spacing = F.concat(F.lit("0.5\\"), F.when(F.col("p_size") % 2 == 0, "0.25").otherwise("1.0"))
    x, y, aspect = G.field_of_view(spacing, F.col("p_size") * 8, F.col("p_size") * 16)
    return part.select("p_partkey", x.alias("fov_x"), y.alias("fov_y"), aspect.alias("aspect_ratio"))


def fingerprint_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a fingerprint table by modality (A3, A4)."""
    rows = A.instances(spark, sf_dir).join(A.studies(spark, sf_dir).select("study_id", "modality"), "study_id")
    return rows.groupBy("modality").agg(F.count("*").alias("n"), F.count_if(F.col("ti").isNull()).alias("without_ti"), F.count_if((F.col("modality") == "MR") & (F.col("te") > 25)).alias("long_te"))


def manufacturer_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical manufacturers by substring."""
    raw = F.concat_ws(" ", F.element_at(F.array(*map(F.lit, ("General Electric", "Siemens AG", "philips", "TOSHIBA medical", "Fujifilm", "acme"))), (F.col("s_suppkey") % 6 + 1).cast("int")), "s_name")
    return _table(spark, sf_dir, "supplier").select("s_suppkey", T.manufacturer(raw).alias("manufacturer"))


def contrast_blob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contrast fields as one lower-cased text, null if all are empty."""
    part = _table(spark, sf_dir, "part")
    dose = F.when(F.col("p_size") % 5 == 0, F.col("p_size").cast("string"))
    agent = F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).when(F.col("p_size") % 3 == 1, F.lit(""))
    return part.select("p_partkey", T.contrast_blob(agent, F.lit(None).cast("string"), dose).alias("contrast_search_blob"))


def text_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised tokens of part names."""
    blob = T.blob(F.concat(F.lit("T1 (3D) MPR+SE*"), F.col("p_name")), F.col("p_type"), F.lit(" "), F.col("p_brand"))
    return _table(spark, sf_dir, "part").select("p_partkey", T.normalise(blob).alias("text_search_blob"))


KEYWORDS = ("password", "license", "ing the", "tion", "ment")


def keyword_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first keyword of a list that a text contains."""
    return _table(spark, sf_dir, "documents").select("doc_id", T.first_keyword(F.col("text"), KEYWORDS).alias("keyword"))


def csv_set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets as sorted text: joined, extended, reduced."""
    raw = F.concat_ws(",", "p_brand", F.lit(" "), "p_brand", F.concat(F.lit("z"), F.col("p_size") % 3))
    return _table(spark, sf_dir, "part").select("p_partkey", C.to_csv(C.to_list(raw)).alias("tidy"), C.add(raw, "base:missing").alias("added"), C.remove(raw, F.col("p_brand")).alias("removed"))


def parse_b_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted distinct b values of a list."""
    raw = F.concat(F.col("p_size") * 100, F.lit("\\0,"), F.col("p_size") * 1000, F.lit(" x 50.5/"), F.col("p_size") * 100)
    return _table(spark, sf_dir, "part").select("p_partkey", F.array_join(D.parse_b_values(raw).cast("array<string>"), ",").alias("b_values"))


def dicom_dates_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header dates and times."""
    key = F.col("o_orderkey")
    date = F.when(key % 4 == 0, F.date_format("o_orderdate", "yyyyMMdd")).when(key % 4 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).when(key % 4 == 2, "19991399").otherwise("junk")
    time = F.when(key % 3 == 0, F.lpad((key % 240000).cast("string"), 6, "0")).when(key % 3 == 1, "12:30:00").otherwise("1230")
    return _table(spark, sf_dir, "orders").select("o_orderkey", D.dicom_date(date).alias("date_text"), D.to_date(date).alias("date"), D.dicom_time(time).alias("time_text"))


def birth_date_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Birth dates in several forms."""
    key = F.col("o_orderkey")
    form = lambda f: F.date_format("o_orderdate", f)
    raw = F.when(key % 5 == 0, form("yyyyMMdd")).when(key % 5 == 1, form("dd/MM/yyyy")).when(key % 5 == 2, form("yyyy-MM-dd")).when(key % 5 == 3, form("dd.MM.yyyy")).otherwise("unknown")
    return _table(spark, sf_dir, "orders").select("o_orderkey", D.birth_date(raw).alias("birth_date"))


def bool_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth values in several forms, with a warning where there is none."""
    raw = F.element_at(F.array(*map(F.lit, ("Yes", "no", "1", "0.0", " TRUE ", "maybe", "2.5"))), (F.col("event_id") % 7 + 1).cast("int"))
    value = D.parse_bool(raw)
    return _table(spark, sf_dir, "events").select("event_id", value.alias("value"), F.when(value.isNull(), F.concat(F.lit("not a truth value: "), raw)).alias("warning"))


def field_strength_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field strengths in tesla or gauss, snapped."""
    raw = F.when(F.col("te") % 2 == 0, F.col("te") / 10 + 0.013).otherwise(F.col("te") * 600)
    return A.instances(spark, sf_dir).select("sop_uid", "part_id", "te", raw.alias("raw"), G.field_strength(raw).alias("field_strength")).distinct()


def physics_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of TR, TE, TI and flip angle (G1)."""
    return gapfill.with_bins(A.instances(spark, sf_dir), "te").select("sop_uid", "part_id", *(f"{c}_bin" for c in gapfill.STEPS), "slice_bin").distinct()


def _gap_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.instances(spark, sf_dir).select("sop_uid", "part_id", "te", (F.col("tr") / 5).alias("tr"), "ti", "fa", "image_type", "coil")
    rows = rows.groupBy("sop_uid").agg(F.min(F.struct("part_id", "te", "tr", "ti", "fa", "image_type", "coil")).alias("r")).select("sop_uid", "r.*")
    sequence = F.when(F.col("image_type") == "R", "SE").when(F.col("image_type") == "A", "GR").otherwise("SE\\EP")
    technique = F.when(F.col("part_id") % 3 == 0, "TSE").when(F.col("part_id") % 3 == 1, "MPRAGE").otherwise("MRF")
    base = F.when(F.col("coil") == "O", "T1w").otherwise("T2w")
    return gapfill.with_bins(rows.withColumns({"scanning_sequence": sequence, "technique": technique, "base": base}))


def gapfill_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stacks without a technique take their nearest neighbours' vote."""
    rows = _gap_rows(spark, sf_dir)
    return gapfill.vote(rows.filter("part_id % 10 = 0"), rows.filter("part_id % 10 != 0"), "sop_uid")


QUERIES = {f.__name__: f for f in (date_from_uid, orientation_from_cosines, fingerprint_source, fingerprint_fov, fingerprint_metrics, manufacturer_normalise, contrast_blob, text_normalise, keyword_first_match, csv_set_ops, parse_b_values, dicom_dates_times, birth_date_formats, bool_parse, field_strength_snap, physics_bins, gapfill_vote)}

_MOVES = ", ".join(f"({r}, {m.get('tr', 0)}, {m.get('te', 0)}, {m.get('ti', 0)}, {m.get('fa', 0)})" for r, m in gapfill._offsets())
_IN = lambda family: ", ".join(f"'{t}'" for t in gapfill.FAMILIES[family])
_CASES = "".join(f" WHEN '{old}' THEN '{new}'" for new, olds in T.TOKENS.items() for old in olds)

ORACLE_SQL = {
    "date_from_uid": "SELECT o_orderkey AS study_id, (SELECT min_by(d, p) FROM (SELECT p, CAST(try_strptime(substr(u, CAST(p AS INTEGER), 8), '%Y%m%d') AS DATE) AS d FROM (SELECT '1.2.840.' || o_orderkey || '.' || strftime(o_orderdate, '%Y%m%d') AS u, unnest(range(1, 40)) AS p) WHERE regexp_matches(substr(u, CAST(p AS INTEGER), 8), '^[0-9]{8}$')) WHERE year(d) BETWEEN 1980 AND 2100) AS recovered FROM orders",
    "orientation_from_cosines": """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), c AS (SELECT vec_id, e[2] * e[6] - e[3] * e[5] AS x, e[3] * e[4] - e[1] * e[6] AS y, e[1] * e[5] - e[2] * e[4] AS z FROM v),
n AS (SELECT vec_id, abs(x) / nullif(sqrt(x * x + y * y + z * z), 0) AS x, abs(y) / nullif(sqrt(x * x + y * y + z * z), 0) AS y, abs(z) / nullif(sqrt(x * x + y * y + z * z), 0) AS z FROM c)
SELECT vec_id, CASE WHEN x IS NULL THEN 'Axial' WHEN x >= y AND x >= z THEN 'Sagittal' WHEN y >= x AND y >= z THEN 'Coronal' ELSE 'Axial' END AS orientation, round(coalesce(greatest(x, y, z), 0.5), 6) AS confidence FROM n""",
    "fingerprint_source": f"""
WITH {A.CTES}, f AS (SELECT DISTINCT ON (series_id, image_type) * FROM instance ORDER BY series_id, image_type, sop_uid, part_id, supplier_id, te, tr)
SELECT f.series_id, f.image_type, f.sop_uid, f.te, f.tr, s.modality, s.study_date, j.subject_code, p_type AS scanning_sequence, p_size AS matrix, s_name AS manufacturer
FROM f JOIN study s USING (study_id) JOIN subject j USING (subject_id) LEFT JOIN part ON p_partkey = part_id LEFT JOIN supplier ON s_suppkey = supplier_id""",
    "fingerprint_fov": """
WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS s, CASE WHEN p_size % 2 = 0 THEN 0.25::DOUBLE ELSE 1.0::DOUBLE END AS c FROM part), f AS (SELECT p_partkey, round(c * s * 16, 2) AS fov_x, round(0.5::DOUBLE * s * 8, 2) AS fov_y FROM p)
SELECT *, CASE WHEN fov_x > 0 AND fov_y > 0 THEN round(greatest(fov_x, fov_y) / least(fov_x, fov_y), 3) END AS aspect_ratio FROM f""",
    "fingerprint_metrics": f"WITH {A.CTES} SELECT modality, count(*) AS n, count(*) FILTER (ti IS NULL) AS without_ti, count(*) FILTER (modality = 'MR' AND te > 25) AS long_te FROM instance JOIN study USING (study_id) GROUP BY 1",
    "manufacturer_normalise": """
WITH n AS (SELECT s_suppkey, upper(trim((['General Electric', 'Siemens AG', 'philips', 'TOSHIBA medical', 'Fujifilm', 'acme'])[s_suppkey % 6 + 1] || ' ' || s_name)) AS m FROM supplier)
SELECT s_suppkey, CASE WHEN m LIKE '%TOSHIBA%' THEN 'CANON' WHEN m LIKE '%GE%' THEN 'GE' WHEN m LIKE '%SIEMENS%' THEN 'SIEMENS' WHEN m LIKE '%PHILIPS%' THEN 'PHILIPS' WHEN m LIKE '%CANON%' THEN 'CANON' WHEN m LIKE '%FUJI%' THEN 'FUJI' WHEN m LIKE '%HITACHI%' THEN 'HITACHI' ELSE m END AS manufacturer FROM n""",
    "contrast_blob": """
SELECT p_partkey, nullif(lower(concat_ws(' ', CASE WHEN p_size % 3 = 0 THEN 'agent:' || p_brand END, CASE WHEN p_size % 5 = 0 THEN 'dose:' || p_size END)), '') AS contrast_search_blob FROM part""",
    "text_normalise": f"""
WITH t AS (SELECT p_partkey, lower('T1  3D  MPR+SEstar' || p_name || ' ' || p_type || ' ' || p_brand) AS t FROM part),
s AS (SELECT p_partkey, regexp_replace(regexp_replace(t, '([+-])', ' \\1', 'g'), '[^a-z0-9_+-]+', ' ', 'g') AS t FROM t),
w AS (SELECT p_partkey, unnest(string_split(trim(t), ' ')) AS w, generate_subscripts(string_split(trim(t), ' '), 1) AS i FROM s),
m AS (SELECT p_partkey, i, CASE w{_CASES} ELSE w END AS w FROM w WHERE w NOT IN ('', '+', '-', {", ".join(f"'{d}'" for d in T.DROPPED)})),
h AS (SELECT *, bool_or(w = '3d') OVER (PARTITION BY p_partkey) AND bool_or(w = 't1w') OVER (PARTITION BY p_partkey) AS whole FROM m),
d AS (SELECT p_partkey, CASE WHEN w = 'mpr' AND whole THEN 'mprage' ELSE w END AS w, min(i) AS i FROM h GROUP BY 1, 2)
SELECT p_partkey, string_agg(w, ' ' ORDER BY i) AS text_search_blob FROM d GROUP BY 1""",
    "keyword_first_match": "SELECT doc_id, CASE " + " ".join(f"WHEN contains(lower(text), '{k}') THEN '{k}'" for k in KEYWORDS) + " END AS keyword FROM documents",
    "csv_set_ops": """
WITH r AS (SELECT p_partkey, p_brand, [p_brand, 'z' || p_size % 3] AS l FROM part)
SELECT p_partkey, array_to_string(list_sort(list_distinct(l)), ',') AS tidy, array_to_string(list_sort(list_distinct(l || ['base:missing'])), ',') AS added,
    array_to_string(list_sort(list_filter(l, lambda x: x <> p_brand)), ',') AS removed FROM r""",
    "parse_b_values": "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter([p_size * 100, 0, p_size * 1000, 50], lambda x: x BETWEEN 0 AND 20000))), ',') AS b_values FROM part",
    "dicom_dates_times": """
WITH r AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN '1999-13-99' END AS d,
    lpad(CAST(o_orderkey % 240000 AS VARCHAR), 6, '0') AS t FROM orders)
SELECT o_orderkey, d AS date_text, CAST(try_strptime(d, '%Y-%m-%d') AS DATE) AS date, CASE o_orderkey % 3 WHEN 0 THEN t[1:2] || ':' || t[3:4] || ':' || t[5:6] WHEN 1 THEN '12:30:00' END AS time_text FROM r""",
    "birth_date_formats": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 4 THEN CAST(o_orderdate AS DATE) END AS birth_date FROM orders",
    "bool_parse": """
SELECT event_id, ([true, false, true, false, true, NULL, true])[event_id % 7 + 1] AS value, CASE WHEN event_id % 7 = 5 THEN 'not a truth value: maybe' END AS warning FROM events""",
    "field_strength_snap": f"""
WITH {A.CTES}, r AS (SELECT DISTINCT sop_uid, part_id, te, CASE WHEN te % 2 = 0 THEN te / 10 + 0.013::DOUBLE ELSE te * 600 END AS raw FROM instance), t AS (SELECT *, CASE WHEN raw > 100 THEN raw / 10000 ELSE raw END AS tesla FROM r)
SELECT sop_uid, part_id, te, raw, (list_sort(list_transform([0.5, 1.0, 1.5, 3.0, 7.0]::DOUBLE[], lambda s: {{'d': abs(tesla - s), 's': s}})))[1].s AS field_strength FROM t""",
    "physics_bins": f"""
WITH {A.CTES} SELECT DISTINCT sop_uid, part_id, CAST(round_even(tr / 100, 0) * 100 AS INTEGER) AS tr_bin, CAST(round_even(te / 5, 0) * 5 AS INTEGER) AS te_bin, CAST(round_even(ti / 100, 0) * 100 AS INTEGER) AS ti_bin,
    CAST(round_even(fa / 5, 0) * 5 AS INTEGER) AS fa_bin, CASE WHEN te > 0 THEN CAST(ceil(te / 20) * 20 AS INTEGER) END AS slice_bin FROM instance""",
    "gapfill_vote": f"""
WITH {A.CTES}, one AS (SELECT DISTINCT ON (sop_uid) sop_uid, part_id, te, tr / 5 AS tr, ti, fa, image_type, coil FROM instance ORDER BY sop_uid, part_id, te, tr / 5, ti NULLS FIRST, fa, image_type, coil),
b AS (SELECT sop_uid, part_id, CASE image_type WHEN 'R' THEN 'SE' WHEN 'A' THEN 'GR' ELSE 'SE\\EP' END AS seq, CASE part_id % 3 WHEN 0 THEN 'TSE' WHEN 1 THEN 'MPRAGE' ELSE 'MRF' END AS technique,
    CASE WHEN coil = 'O' THEN 'T1w' ELSE 'T2w' END AS base, CAST(round_even(tr / 100, 0) * 100 AS INTEGER) AS tr, CAST(round_even(te / 5, 0) * 5 AS INTEGER) AS te, CAST(round_even(ti / 100, 0) * 100 AS INTEGER) AS ti, CAST(round_even(fa / 5, 0) * 5 AS INTEGER) AS fa FROM one),
refs AS (SELECT tr, te, ti, fa, base, technique, count(*) AS n FROM b WHERE part_id % 10 <> 0 GROUP BY ALL),
moves(rank, dtr, dte, dti, dfa) AS (VALUES {_MOVES}),
c AS (SELECT sop_uid, seq, rank, tr + dtr * 100 AS tr, te + dte * 5 AS te, ti + dti * 100 AS ti, fa + dfa * 5 AS fa FROM b, moves WHERE part_id % 10 = 0
    AND (dtr = 0 OR tr + dtr * 100 >= 0) AND (dte = 0 OR te + dte * 5 >= 0) AND (dti = 0 OR ti + dti * 100 >= 0) AND (dfa = 0 OR fa + dfa * 5 >= 0)),
met AS (SELECT c.sop_uid, c.seq, c.rank, r.base, r.technique, r.n, min(c.rank) OVER (PARTITION BY c.sop_uid) AS least FROM c JOIN refs r ON c.tr = r.tr AND c.te = r.te AND c.ti IS NOT DISTINCT FROM r.ti AND c.fa = r.fa),
v AS (SELECT sop_uid, seq, rank, base, technique, CAST(sum(n) AS BIGINT) AS n, CASE WHEN technique IN ({_IN("SE")}) THEN seq LIKE '%SE%' OR seq LIKE '%IR%' OR NOT (seq LIKE '%EP%' OR seq LIKE '%GR%') WHEN technique IN ({_IN("GRE")}) THEN seq LIKE '%GR%' OR NOT (seq LIKE '%SE%' OR seq LIKE '%EP%') WHEN technique IN ({_IN("EPI")}) THEN seq LIKE '%EP%' ELSE true END AS fits
    FROM met WHERE rank = least GROUP BY ALL),
w AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY sop_uid ORDER BY fits DESC, n DESC, base, technique) = 1)
SELECT sop_uid, rank, n, CASE WHEN fits AND n >= 2 THEN base END AS base, CASE WHEN fits AND n >= 2 THEN technique END AS technique,
    CASE WHEN fits AND n >= 2 THEN 'filled' WHEN fits THEN 'insufficient_matches' ELSE 'incompatible' END AS outcome FROM w""",
}
