"""The completion of classified stacks, over stacks that orders deal out.

Groups of physics lie too far apart for a neighbour of another group, so the SQL can count votes
within a group; the outcomes of the SWI branch are written out for each header.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom.operators import completion as C

_K = "(o_orderkey + o_custkey)"
#: Base and technique of classified stacks, by group of physics: each the more frequent the earlier.
_PAIRS = ((("T1w", "MPRAGE"), ("T1w", "TSE"), ("PDw", "TSE")), (("SWI", "GRE"), ("T2*w", "FLASH"), ("T2w", "TSE")), (("DWI", "DWI-EPI"), ("T2w", "TSE"), ("T1w", "SE")), (("T2w", "TSE"), ("T2w", "HASTE"), ("T1w", "SE")))
_IMAGES = ("ORIGINAL\\PRIMARY\\M\\SWI", "DERIVED\\PRIMARY\\MINIP", "ORIGINAL\\PRIMARY\\PHASE", "ORIGINAL\\PRIMARY\\M\\ND", None, "DERIVED\\SECONDARY\\MIP")
_SEQUENCES = ("GR", "SE", "EP", None, "RM")
_TEXTS = ("t2 swi tra", "swan 3d", None, "qsm map", "haste cor", "epi fast")
_REASONS = (None, "base:missing,technique:missing", "contrast:low_confidence, base:missing", "technique:conflict")


def _pick(values: tuple, key: str) -> str:
    return f"element_at(array({', '.join('NULL' if v is None else repr(v) for v in values)}), CAST({key} % {len(values)} + 1 AS INT))"


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Cache, fingerprints, stacks, series and studies."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey AS id", f"{_K} AS k", "o_custkey AS subject", "to_date(o_orderdate) AS day")
    pair = lambda i: "CASE " + " ".join(f"WHEN k % 5 = {g} THEN " + _pick(tuple(p[i] for p in pairs), "(CASE WHEN (k div 20) % 6 < 3 THEN 0 WHEN (k div 20) % 6 < 5 THEN 1 ELSE 2 END)") for g, pairs in enumerate(_PAIRS)) + " END"
    kind = "(k div 5) % 4"  # one in four stacks lacks something
    cache = rows.selectExpr(
        "id AS series_stack_id", f"CASE WHEN {kind} = 0 THEN {_pick((None, '', 'Unknown', 'T1w'), '(k div 20)')} ELSE {pair(0)} END AS base",
        f"CASE WHEN {kind} = 0 THEN {_pick(('Unknown', None), '(k div 40)')} ELSE {pair(1)} END AS technique", "CAST(NULL AS STRING) AS construct_csv",
        f"{_pick(('RawRecon', 'RawRecon', None, 'EPIMix', 'RawRecon', 'BOLDRecon', 'ProjectionDerived'), 'k')} AS provenance", f"CASE WHEN {kind} = 0 THEN {_pick(('misc', 'misc', 'excluded', 'misc', 'anat', 'localizer'), '(k div 3)')} ELSE 'anat' END AS directory_type",
        "CAST(CASE WHEN k % 31 = 0 THEN 1 ELSE 0 END AS INT) AS localizer", "CAST(CASE WHEN k % 3 = 0 THEN 1 WHEN k % 3 = 1 THEN 0 END AS INT) AS post_contrast", "0 AS manual_review_required", f"{_pick(_REASONS, 'k')} AS manual_review_reasons_csv",
    )
    images, sequences, texts = (tuple(v.replace("\\", "\\\\") if v else v for v in x) for x in (_IMAGES, _SEQUENCES, _TEXTS))
    literal = lambda values, key: "CASE " + " ".join(f"WHEN {key} % {len(values)} = {i} THEN '{v}'" for i, v in enumerate(values) if v is not None) + " END"
    fingerprints = rows.selectExpr(
        "id AS series_stack_id", "CASE WHEN k % 37 = 0 THEN 'CT' ELSE 'MR' END AS modality", "CASE WHEN k % 2 = 0 THEN '3D' END AS mr_acquisition_type", "CAST((k % 5) * 2000 + 1000 AS DOUBLE) AS mr_tr", "CAST((k % 5) * 100 + 20 AS DOUBLE) AS mr_te",
        "CAST(NULL AS DOUBLE) AS mr_ti", "90.0D AS mr_flip_angle", "30 AS stack_n_instances", f"{literal(texts, '(k div 7)')} AS text_search_blob", f"{literal(images, '(k div 11)')} AS image_type", f"{literal(sequences, '(k div 13)')} AS scanning_sequence",
        "CAST(NULL AS STRING) AS sequence_variant", "CAST(NULL AS STRING) AS scan_options", "CAST(NULL AS STRING) AS stack_sequence_name", "'Axial' AS stack_orientation",
    )
    stacks = rows.selectExpr("id AS series_stack_id", "id + 7 AS series_id", "0 AS stack_index", "CAST(NULL AS STRING) AS stack_key", "CASE WHEN k % 29 = 0 THEN 0.6D WHEN k % 23 <> 0 THEN 0.9D END AS stack_orientation_confidence")
    return cache, fingerprints, stacks, rows.selectExpr("id + 7 AS series_id", "concat('1.2.', id) AS series_instance_uid", "id AS study_id"), rows.selectExpr("id AS study_id", "CASE WHEN id % 19 <> 0 THEN day END AS study_date", "subject AS subject_id")


def completion_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stacks after all phases of the completion."""
    cache, fingerprints, stacks, series, studies = _tables(spark, sf_dir)
    done = C.completion_pass(C.load_for_completion(cache, fingerprints, stacks, series, studies), C.reference_stacks(cache, fingerprints))
    return done.select("series_stack_id", "base", "technique", "construct_csv", "provenance", "directory_type", "mr_acquisition_type", "manual_review_required", "manual_review_reasons_csv", "fill", "touched")


def classification_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of the stacks of a part of the series, with stack and series."""
    _, fingerprints, stacks, series, _ = _tables(spark, sf_dir)
    found = C.load_for_classification(fingerprints, stacks.filter("series_stack_id % 3 <> 0"), series.filter("study_id % 4 <> 1"))
    return found.select("series_stack_id", "series_instance_uid", "stack_index", "modality", "mr_te", "text_search_blob")


def field_strength_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series whose field strength changes when it is snapped."""
    raw = "CASE WHEN o_orderkey % 6 = 0 THEN 1.5D WHEN o_orderkey % 6 = 1 THEN 15000.0D WHEN o_orderkey % 6 = 2 THEN 1.4938D WHEN o_orderkey % 6 = 3 THEN 0.2D WHEN o_orderkey % 6 = 4 THEN 3.0005D END"
    return C.normalised_strengths(spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey AS series_id", f"{raw} AS magnetic_field_strength"))


QUERIES = {f.__name__: f for f in (completion_pass, classification_load, field_strength_updates)}


def _at(values: tuple, key: str) -> str:
    return f"([{', '.join('NULL' if v is None else repr(v) for v in values)}])[{key} % {len(values)} + 1]"


def _raw(values: tuple, key: str) -> str:
    quoted = ", ".join("NULL" if v is None else "'" + v + "'" for v in values)
    return f"([{quoted}])[{key} % {len(values)} + 1]"


_PLACE = "(CASE WHEN (k // 20) % 6 < 3 THEN 1 WHEN (k // 20) % 6 < 5 THEN 2 ELSE 3 END)"
_OWN = lambda i: "CASE k % 5 " + " ".join(f"WHEN {g} THEN ([{', '.join(repr(p[i]) for p in pairs)}])[{_PLACE}]" for g, pairs in enumerate(_PAIRS)) + " END"

ORACLE_SQL = {
    "completion_pass": f"""
WITH s AS (SELECT o_orderkey AS id, {_K} AS k, o_custkey AS subject, CASE WHEN o_orderkey % 19 <> 0 THEN CAST(o_orderdate AS DATE) END AS day FROM orders),
a AS (SELECT id, k, subject, day, CASE WHEN (k // 5) % 4 = 0 THEN {_at((None, '', 'Unknown', 'T1w'), '(k // 20)')} ELSE {_OWN(0)} END AS base, CASE WHEN (k // 5) % 4 = 0 THEN {_at(('Unknown', None), '(k // 40)')} ELSE {_OWN(1)} END AS technique,
    {_at(('RawRecon', 'RawRecon', None, 'EPIMix', 'RawRecon', 'BOLDRecon', 'ProjectionDerived'), 'k')} AS prov, CASE WHEN (k // 5) % 4 = 0 THEN {_at(('misc', 'misc', 'excluded', 'misc', 'anat', 'localizer'), '(k // 3)')} ELSE 'anat' END AS folder,
    k % 31 = 0 AS scout, CASE k % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS contrast, {_raw(_REASONS, 'k')} AS reasons, k % 37 <> 0 AS mr, CASE WHEN k % 2 = 0 THEN '3D' END AS dims,
    {_raw(_TEXTS, '(k // 7)')} AS t, {_raw(_IMAGES, '(k // 11)')} AS image, {_raw(_SEQUENCES, '(k // 13)')} AS seq, k % 29 = 0 AS doubt FROM s),
w AS (SELECT *, CASE WHEN mr AND dims IS NULL THEN CASE WHEN t = 'swan 3d' THEN '3D' WHEN t = 'haste cor' THEN '2D' WHEN technique = 'MPRAGE' THEN '3D' WHEN technique IN ('TSE', 'GRE', 'FLASH', 'DWI-EPI', 'SE') THEN '2D' END END AS told,
    mr AND folder <> 'excluded' AND coalesce(prov, '') NOT IN ('EPIMix', 'BOLDRecon') AND (coalesce(base, '') IN ('', 'Unknown') OR coalesce(technique, 'Unknown') = 'Unknown') AS asked FROM a),
refs AS (SELECT k % 5 AS g, base, technique, count(*) AS n FROM a WHERE mr AND base <> 'Unknown' AND technique <> 'Unknown' AND folder <> 'excluded' GROUP BY ALL),
v AS (SELECT w.id, r.base AS vb, r.technique AS vt, r.n, CASE WHEN seq IS NULL THEN true WHEN seq = 'RM' THEN r.technique <> 'DWI-EPI' WHEN r.technique = 'DWI-EPI' THEN seq = 'EP' WHEN r.technique IN ('MPRAGE', 'GRE', 'FLASH') THEN seq = 'GR' ELSE seq = 'SE' END AS fits
    FROM w JOIN refs r ON w.k % 5 = r.g WHERE asked),
b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY fits DESC, n DESC, vb, vt) = 1),
f AS (SELECT w.*, CASE WHEN fits AND n >= 2 THEN vb END AS vb, CASE WHEN fits AND n >= 2 THEN vt END AS vt, CASE WHEN asked THEN CASE WHEN fits IS NULL THEN 'no_match' WHEN NOT fits THEN 'incompatible' WHEN n < 2 THEN 'insufficient_matches' ELSE 'filled' END END AS fill FROM w LEFT JOIN b USING (id)),
g AS (SELECT *, coalesce(base, '') = '' AND vb IS NOT NULL AS fb, coalesce(technique, 'Unknown') = 'Unknown' AND vt IS NOT NULL AS ft, coalesce(vb = 'SWI' AND coalesce(base, '') IN ('', 'Unknown'), false) AS swi FROM f),
h AS (SELECT *, CASE WHEN swi OR fb THEN vb ELSE base END AS base2, CASE WHEN swi THEN CASE WHEN seq = 'EP' THEN 'EPI' WHEN seq = 'GR' THEN 'GRE' WHEN t = 'epi fast' THEN 'EPI' ELSE 'GRE' END WHEN ft THEN vt ELSE technique END AS technique2,
    CASE WHEN swi THEN CASE WHEN t = 'qsm map' THEN 'QSM' WHEN image LIKE '%MINIP' THEN 'MinIP' WHEN image LIKE '%MIP' THEN 'MIP' WHEN image LIKE '%PHASE' THEN 'Phase' WHEN image LIKE '%SWI' THEN 'SWI' WHEN image LIKE '%ND' THEN 'Magnitude' ELSE 'SWI' END END AS constructs,
    CASE WHEN swi THEN 'SWIRecon' ELSE prov END AS prov2, doubt AND mr OR told IS NOT NULL OR asked AS touched1 FROM g),
i AS (SELECT *, CASE WHEN swi THEN 'anat' WHEN folder = 'misc' AND touched1 THEN CASE WHEN scout THEN 'localizer' WHEN prov2 = 'BOLDRecon' THEN 'func' WHEN base2 = 'DWI' THEN 'dwi' WHEN base2 IN ('T1w', 'T2w', 'PDw', 'T2*w', 'SWI') THEN 'anat' WHEN prov2 = 'ProjectionDerived' THEN 'anat' ELSE 'misc' END ELSE folder END AS folder2,
    concat_ws('|', coalesce(base2, ''), coalesce(technique2, ''), k % 5) AS look FROM h),
c AS (SELECT subject, day, look FROM i WHERE contrast IS NOT NULL AND day IS NOT NULL GROUP BY ALL HAVING count(*) > 1 AND min(contrast) = max(contrast)),
j AS (SELECT i.*, contrast IS NOT NULL AND c.look IS NOT NULL AS alike FROM i LEFT JOIN c ON i.subject = c.subject AND i.day = c.day AND i.look = c.look)
SELECT id AS series_stack_id, base2 AS base, technique2 AS technique, constructs AS construct_csv, prov2 AS provenance, folder2 AS directory_type, coalesce(told, dims) AS mr_acquisition_type, CAST(touched1 OR alike AS INTEGER) AS manual_review_required,
    CASE WHEN touched1 OR alike THEN array_to_string(list_sort(list_distinct(list_filter(list_concat(list_filter(list_transform(string_split(coalesce(reasons, ''), ','), lambda x: trim(x)), lambda x: x <> '' AND NOT (fb AND x = 'base:missing') AND NOT (ft AND x = 'technique:missing')),
        [CASE WHEN fb THEN 'base:low_confidence' END, CASE WHEN ft THEN 'technique:low_confidence' END, CASE WHEN doubt AND mr THEN 'orientation:low_confidence' END, CASE WHEN alike THEN 'contrast:duplicate_prediction' END]), lambda x: x IS NOT NULL))), ',') ELSE reasons END AS manual_review_reasons_csv,
    fill, touched1 OR alike AS touched FROM j""",
    "classification_load": f"""SELECT o_orderkey AS series_stack_id, '1.2.' || o_orderkey AS series_instance_uid, 0 AS stack_index, CASE WHEN {_K} % 37 = 0 THEN 'CT' ELSE 'MR' END AS modality, CAST({_K} % 5 * 100 + 20 AS DOUBLE) AS mr_te,
    {_raw(_TEXTS, f'({_K} // 7)')} AS text_search_blob FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 4 <> 1""",
    "field_strength_updates": "SELECT o_orderkey AS series_id, CASE o_orderkey % 6 WHEN 1 THEN 15000.0::DOUBLE WHEN 2 THEN 1.4938::DOUBLE ELSE 0.2::DOUBLE END AS old, CASE o_orderkey % 6 WHEN 3 THEN 0.5::DOUBLE ELSE 1.5::DOUBLE END AS new FROM orders WHERE o_orderkey % 6 IN (1, 2, 3)",
}
