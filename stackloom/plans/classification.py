"""Classification, quality control and export of stacks.

The stacks are line items and orders with the headers of a protocol each. The oracles hold the
outcome of every protocol as literals, taken from a run and reasoned through one by one against
what the detectors are to do, and rules, folders and names as SQL of their own; no expression is
shared with the operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom.operators import export as E
from stackloom.operators import gapfill, qc, rules
from stackloom.operators import review as R
from stackloom.plans.protocols import FIELDS, PROTOCOLS
from stackloom.sources import adapter as A

_N = len(PROTOCOLS)


def _protocols(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *p) for i, p in enumerate(PROTOCOLS)], f"protocol int, {FIELDS}")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).select(
        F.concat_ws(".", "l_orderkey", "l_linenumber").alias("stack_id"),
        (F.col("l_partkey") % _N).cast("int").alias("protocol"),
        (F.col("l_quantity") / 25).alias("aspect"),
        (F.col("l_suppkey") % 90 + 1).cast("int").alias("n_instances"),
    )
    return rules.classify(rows.join(F.broadcast(_protocols(spark)), "protocol"), ["stack_id", "aspect", "n_instances"])  # the table of protocols is a constant


def classify_stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All axes, confidences, folder and review reasons of every stack."""
    return _classified(spark, sf_dir).withColumns({c: F.round(c, 4) for c in ("provenance_confidence", "technique_confidence", "base_confidence")})


def classification_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stacks by intent, base, technique, provenance, contrast and review (A10)."""
    rows = _classified(spark, sf_dir)
    review = F.when(F.col("review_reasons") == "", "0").otherwise("1")
    axes = {"intent": F.col("intent"), "base": F.col("base"), "technique": F.col("technique"), "provenance": F.col("provenance"), "post_contrast": F.col("post_contrast").cast("string"), "review": review}
    # Counted by all axes together first: what is exploded then are a few combinations.
    counted = rows.select(*(c.alias(n) for n, c in axes.items())).groupBy(*axes).agg(F.count("*").alias("k"))
    again = F.explode(F.array(*(F.struct(F.lit(n).alias("axis"), F.col(n).alias("value")) for n in axes)))
    return counted.select(again.alias("x"), "k").groupBy("x.axis", "x.value").agg(F.sum("k").alias("n"))


def review_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stacks by each of their review reasons (A10)."""
    counted = _classified(spark, sf_dir).groupBy("review_reasons").agg(F.count("*").alias("k")).filter("review_reasons <> ''")
    return counted.select(F.explode(F.split("review_reasons", ",")).alias("reason"), "k").groupBy("reason").agg(F.sum("k").alias("n"))


_RULE_FIELDS = "base technique provenance constructs intent localizer spinal_cord post_contrast aspect n_instances".split()


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as stored classifications whose axes are dealt out so that every rule finds some."""
    k = F.col("k")
    number = lambda values, key: _dealt(values, key).cast("int")
    return _orders(spark, sf_dir).withColumns({
        "base": _dealt(("T1w", None, "", "T2w", "Unknown"), k), "technique": _dealt(("TSE", None, "EPI", "", "MPRAGE", "RESOLVE", "Unknown"), k),
        "provenance": _dealt(("RawRecon", "SWIRecon", None, "DTIRecon", "SyMRI", "PerfusionRecon", "EPIMix", "Localizer", "RawRecon", "RawRecon", "RawRecon"), k),
        "constructs": _dealt((None, "SWI,Phase", "", "QSM", "ADC,FA", "T1map", "CBF", None, "", None, "Other", None, None), k),
        "intent": _dealt(("anat", "anat", "dwi", "localizer", None, "excluded", "anat", "fmap"), F.floor(k / 2)), "localizer": number((0, 0, None, 1), F.floor(k / 3)),
        "spinal_cord": number((None, 0, 1), F.floor(k / 5)), "post_contrast": number((None, 1, 0), F.floor(k / 7)),
        "aspect": F.when(k % 9 != 0, (k % 30) / 12), "n_instances": F.when(k % 8 != 0, (k % 40).cast("int")),
    })


def qc_rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violated rules of every stack, as classified and as stored (Q1-Q10)."""
    localizer = F.when(F.col("provenance") == "Localizer", 1).otherwise(0)
    classified = R.violations(_classified(spark, sf_dir).withColumn("localizer", localizer), ["stack_id"])
    stored = R.violations(_stored(spark, sf_dir).select(F.concat(F.lit("o"), "stack_id").alias("stack_id"), *_RULE_FIELDS), ["stack_id"])
    return classified.union(stored)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as stacks whose axes are dealt out by their keys, for the steps after detection."""
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("stack_id"), F.col("o_custkey").alias("subject_id"), F.to_date("o_orderdate").alias("study_date"), (F.col("o_orderkey") + F.col("o_custkey")).alias("k"))


def _dealt(values: tuple, key: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (key % len(values) + 1).cast("int"))


_BASES = ("T1w", None, "DWI", "T2w", None, "PWI", "SWI")
_CONSTRUCTS = (None, "ADC", "MinIP", "InPhase,OutPhase", "Fat,InPhase,OutPhase", "T1map", "AD", "PhaseMap", "B0map", "SyntheticT1w", None, "PhaseMap,SWIProcessed", "CBF")
_PROVENANCES = ("RawRecon", "SWIRecon", "Localizer", "DTIRecon", "ProjectionDerived", "BOLDRecon", "SyMRI", "ASLRecon", "RawRecon", "RawRecon", "RawRecon")
_TEXTS = (None, "resting state epi", "bold tse", "t1 sag", "task-motor")
_TECHNIQUES = ("TSE", "GRE-EPI", "MPRAGE")


def intent_synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folder that the axes of a stack lead to."""
    k = F.col("k")
    columns = {"base": _dealt(_BASES, k), "constructs": _dealt(_CONSTRUCTS, k), "provenance": _dealt(_PROVENANCES, k), "text": _dealt(_TEXTS, k), "technique": _dealt(_TECHNIQUES, k), "branch_output": F.lit(None).cast("string"), "branch_key": F.lit(None).cast("string")}
    return _orders(spark, sf_dir).withColumns(columns).select("stack_id", F.expr(rules.intent()).alias("intent"))


def acceleration_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acceleration methods named in the documents, with a few words put behind each text."""
    words = ("", " grappa", " mb3 t2", "_cs_ csf", " 7/8", " the number twist", " combat", " arc[2x1]", " caipi pf", " sms_x", " fse_arc")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.concat(F.coalesce("text", F.lit("")), _dealt(words, F.col("doc_id"))).alias("text"), _dealt((None, "cmrr_ep", "fldyn3d", "tse"), F.col("doc_id")).alias("s"))
    return rows.select("doc_id", rules.acceleration({}, F.col("text"), F.col("s")).alias("accelerations"))


def acquisition_type_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2D or 3D where a stack does not say it, and how it was told."""
    k = F.col("k")
    told = gapfill.acquisition_type(_dealt((None, None, "", "3D"), k), k % 19 == 0, k % 23 == 0, _dealt((None, "T1 MPRAGE", "ssh Haste", "sag"), F.floor(k / 4)), _dealt(("TSE", "SWI", "ASL"), F.floor(k / 3)))
    return _orders(spark, sf_dir).select("stack_id", told["value"].alias("acquisition_type"), told["method"].alias("method"))


def technique_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a technique can come from a scanning sequence."""
    k = F.col("k")
    sequence = _dealt((None, "", "RM", "['RM']", "SE\\IR", "ep", "GR", "IR", "RM\\GR", "XX"), k)
    technique = _dealt(("TIRM", "MPRAGE", "DWI-EPI", "ASL", None, "TSE", "EPI"), F.floor(k / 10))
    return _orders(spark, sf_dir).select("stack_id", gapfill.compatible(technique, sequence).alias("fits"))


_REASONS = (None, "base:missing", "technique:conflict,base:low_confidence", "bodypart:spine_detected,contrast:low_confidence", "provenance:ambiguous,technique:odd", "excluded:screenshot", "base:low_confidence,base:missing", "")


def _reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return _orders(spark, sf_dir).withColumn("review_reasons", _dealt(_REASONS, k))


def qc_categorise_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories and priority of every item (Q11, Q12)."""
    return _reviewed(spark, sf_dir).select("stack_id", F.explode(qc.categories(F.col("review_reasons"))).alias("category"), qc.priority(F.col("review_reasons")).alias("priority"))


def qc_axis_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The problem of each axis of every item (Q13)."""
    return _reviewed(spark, sf_dir).select("stack_id", *(qc.axis_flag(F.col("review_reasons"), a).alias(f"{a}_flag") for a in qc.AXES))


def qc_available_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axes and flags that some item has (Q15)."""
    return qc.available_filters(_reviewed(spark, sf_dir), "review_reasons")


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return _reviewed(spark, sf_dir).select(
        "stack_id", F.col("stack_id").alias("series_id"), "subject_id", "study_date", "review_reasons",
        F.when(F.coalesce("review_reasons", F.lit("")) == "", 0).otherwise(1).alias("review_required"),
        F.when(k % 17 == 0, "asia").alias("origin"), F.when(k % 13 == 0, "localizer").when(k % 11 != 0, "anat").alias("intent"),
        F.when(k % 3 != 0, k % 7).alias("field_strength"), _dealt(("GE", "SIEMENS", None), k).alias("manufacturer"), _dealt(("m1", "m2"), k).alias("model"),
        F.lit("T1w").alias("base"), F.lit("TSE").alias("technique"), F.lit("FLAIR").alias("modifiers"), F.lit("RawRecon").alias("provenance"), F.lit("ADC").alias("constructs"),
    )


def _drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = F.when(F.col("l_linenumber") == 1, "base").otherwise("technique").alias("field")
    newest = _lines(spark, sf_dir).filter("l_linenumber <= 2").groupBy(F.col("l_orderkey").alias("series_id"), field).agg(F.max("l_suppkey").alias("draft_id"))
    return newest.filter("draft_id % 3 <> 0").withColumn("new_value", F.concat(F.lit("v"), F.col("draft_id") % 5))


def _worklist(spark: SparkSession, sf_dir: str, axis: str | None, flag: str | None) -> DataFrame:
    return qc.worklist(_cache(spark, sf_dir), A.subjects(spark, sf_dir), A.subject_cohorts(spark, sf_dir), A.cohorts(spark, sf_dir), _drafts(spark, sf_dir), 2, axis, flag)


_SHOWN = ("stack_id", "subject_code", "study_date", "field_strength", "manufacturer", "review_reasons", "has_draft", "draft_changes")


def qc_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a cohort's worklist on base problems: items 101 to 600."""
    return qc.worklist_page(_worklist(spark, sf_dir, "base", None), 100, 500)[0].select(*_SHOWN)


def qc_worklist_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole worklists by axis and flag: any reason of the axis counts."""
    asked = (("base", "missing"), ("technique", "conflict"), (None, "low_confidence"), (None, None))
    parts = [_worklist(spark, sf_dir, a, f).select(F.lit(f"{a or 'any'}:{f or 'any'}").alias("asked"), "stack_id", "review_reasons", "has_draft") for a, f in asked]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


def qc_confirm_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache after its drafts are confirmed."""
    return qc.confirm_drafts(_cache(spark, sf_dir), _drafts(spark, sf_dir)).select("stack_id", "base", "technique", "modifiers", "review_required", "review_reasons")


def _stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    lines = _lines(spark, sf_dir).select(F.concat_ws(".", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").alias("stack_id"), (F.col("l_orderkey") * 3 + F.col("l_suppkey") % 3).alias("series_id"), F.concat(F.lit("S"), F.col("l_orderkey") % 500).alias("subject_code"), F.to_date("l_shipdate").alias("study_date"), (F.col("l_linenumber") - 1).alias("stack_index"), (F.col("l_partkey") + F.col("l_suppkey")).alias("k"))
    return lines.withColumns({
        "orientation": _dealt(("Axial", "Oblique", None, "Sagittal"), k), "base": _dealt(("T1w", None, "T2w"), k), "acquisition_type": _dealt(("3D", None), k),
        "modifiers": _dealt((None, "FLAIR,FatSat"), k), "technique": _dealt(("TSE", None, "MPRAGE", "GRE", None), k), "accelerations": _dealt(("", "ParallelImaging"), k),
        "constructs": _dealt((None, None, "ADC,FA"), k), "spinal_cord": F.when(k % 7 == 0, 1), "post_contrast": F.when(k % 5 == 0, 1).when(k % 5 == 1, 0),
        "stack_key": _dealt((None, "multi_echo", "multi_ti", "multi_orientation"), k), "provenance": _dealt(("RawRecon", "SyMRI", None, "SWIRecon", "EPIMix"), k),
        "intent": _dealt(("anat", "dwi", None), k), "series_time": F.when(k % 4 != 0, F.lpad((k % 50).cast("string"), 6, "0")),
    })


def export_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of all stacks in an export, and which of them are there already."""
    there = _lines(spark, sf_dir).select(F.concat(F.lit("sub-S"), F.col("l_orderkey") % 500, F.lit("/ses-19980101/dwi/T1w_3D_TSE")).alias("path"))
    planned = E.plan(_stacks(spark, sf_dir), existing=there)
    return planned.select("stack_id", "folder", "path", "skip")


def resolved_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the files of stacks lie: absolute, below the root, or in a folder that begins with sub-."""
    c = F.col("o_custkey")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    folder = F.concat(F.lit("P"), c, F.lit("/"), F.col("o_orderkey"))
    stacks = orders.select(F.col("o_orderkey").alias("stack_id"), F.when(c % 7 == 0, F.concat(F.lit("/abs/"), folder)).when(c % 11 != 0, folder).alias("path"))
    listing = orders.filter(c % 3 != 2).select(F.concat(F.when(c % 3 == 0, "/raw/").otherwise("/raw/sub-"), folder).alias("path"))
    both = orders.filter(c % 6 == 0).select(F.concat(F.lit("/raw/sub-"), folder).alias("path"))
    return E.resolved_sources(stacks, listing.union(both).union(both), "/raw/")


def export_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stacks that an export's filters leave."""
    return E.chosen(_stacks(spark, sf_dir), intents=("anat", "misc"), include=("SyMRI",), exclude=("RawRecon",)).groupBy("intent", "provenance").agg(F.count("*").alias("n"))


_ALL = (classify_stacks, classification_breakdown, review_reason_counts, qc_rule_violations, intent_synthesis, acceleration_regex, acquisition_type_inference, technique_compatibility, qc_categorise_priority, qc_axis_flags, qc_available_filters, qc_worklist, qc_worklist_flags, qc_confirm_drafts, export_plan, resolved_sources, export_filters)
QUERIES = {f.__name__: f for f in _ALL}

# Protocol -> what the detectors are to make of it: provenance and confidence,
# technique and confidence, base and confidence, modifiers, constructs, accelerations, contrast,
# spine, why excluded, intent, reasons without those of the spine heuristic, and whether it can apply.
_EXPECTED = """expected(protocol, provenance, provenance_confidence, technique, technique_confidence, base, base_confidence, modifiers, constructs,
    accelerations, post_contrast, spinal_cord, excluded, intent, reasons, stretches) AS (VALUES
(0, 'RawRecon', 0.8, 'MPRAGE', 0.95, 'T1w', 0.95, NULL, NULL, '', NULL, 0, NULL, 'anat', 'contrast:low_confidence', false),
(1, 'RawRecon', 0.8, 'TSE', 0.95, 'T2w', 0.7, 'FatSat', NULL, '', NULL, NULL, NULL, 'anat', 'body_part:low_confidence,contrast:low_confidence', true),
(2, 'DTIRecon', 0.95, 'RESOLVE', 0.75, 'DWI', 0.9, 'FatSat', 'ADC', 'PartialFourier', NULL, NULL, NULL, 'dwi', 'body_part:low_confidence,contrast:low_confidence', false),
(3, 'SWIRecon', 0.95, 'GRE', 0.75, 'SWI', 0.9, NULL, 'SWI', '', NULL, NULL, NULL, 'anat', 'body_part:low_confidence,contrast:low_confidence', true),
(4, 'SWIRecon', 0.95, 'GRE', 0.75, 'SWI', 0.95, NULL, 'MinIP', '', NULL, NULL, NULL, 'anat', 'body_part:low_confidence,contrast:low_confidence', true),
(5, 'SWIRecon', 0.85, 'GRE', 0.75, 'SWI', 0.9, NULL, 'Phase', '', NULL, NULL, NULL, 'anat', 'body_part:low_confidence,contrast:low_confidence', true),
(6, 'SyMRI', 0.85, 'MDME', 0.85, NULL, 0.95, NULL, 'T1map', '', NULL, NULL, NULL, 'anat', 'body_part:low_confidence,contrast:low_confidence', false),
(7, 'SyMRI', 0.85, 'MDME', 0.85, 'T2w', 0.95, 'FLAIR', 'SyntheticFLAIR', '', NULL, NULL, NULL, 'anat', 'body_part:low_confidence,contrast:low_confidence', false),
(8, 'EPIMix', 0.85, 'SE-EPI', 0.75, 'T1w', 0.9, 'FLAIR', NULL, '', NULL, NULL, NULL, 'anat', 'body_part:low_confidence,contrast:low_confidence', false),
(9, 'EPIMix', 0.85, 'HASTE', 0.85, 'T2w', 0.9, 'FLAIR', NULL, '', NULL, 0, NULL, 'anat', 'contrast:low_confidence', false),
(10, 'EPIMix', 0.85, 'GRE-EPI', 0.75, 'T2*w', 0.75, NULL, NULL, '', NULL, NULL, NULL, 'anat', 'body_part:low_confidence,contrast:low_confidence', false),
(11, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'secondary_reformat', 'excluded', 'excluded:secondary_reformat', false),
(12, 'Localizer', 0.95, 'FLASH', 0.95, 'T1w', 0.7, NULL, NULL, '', NULL, NULL, NULL, 'localizer', 'body_part:low_confidence,contrast:low_confidence', true),
(13, 'BOLDRecon', 0.85, 'RESOLVE', 0.75, NULL, 0.5, NULL, NULL, 'SimultaneousMultiSlice', NULL, 0, NULL, 'func', 'base:low_confidence,contrast:low_confidence', false),
(14, 'RawRecon', 0.8, 'TIRM', 0.85, 'T2w', 0.85, 'FLAIR', NULL, 'PartialFourier', NULL, 1, NULL, 'anat', 'bodypart:spine_detected,contrast:low_confidence', false),
(15, 'RawRecon', 0.8, 'VIBE', 0.85, 'T1w', 0.7, NULL, NULL, 'ParallelImaging', 1, NULL, NULL, 'anat', 'body_part:low_confidence', true),
(16, 'RawRecon', 0.8, 'SE', 0.95, 'T1w', 0.7, NULL, NULL, '', 0, NULL, NULL, 'anat', 'body_part:low_confidence', true),
(17, 'RawRecon', 0.8, 'SE', 0.95, 'T2*w', 0.85, NULL, NULL, '', NULL, NULL, NULL, 'anat', 'body_part:low_confidence,contrast:low_confidence,technique:conflict', true),
(18, 'RawRecon', 0.8, 'Unknown', 0.0, NULL, 0.5, NULL, NULL, '', NULL, NULL, NULL, 'misc', 'base:low_confidence,base:missing,body_part:low_confidence,contrast:low_confidence,technique:low_confidence', false),
(19, 'PerfusionRecon', 0.95, 'EPI', 0.95, 'PWI', 0.9, NULL, 'CBF', '', NULL, NULL, NULL, 'perf', 'body_part:low_confidence,contrast:low_confidence', false),
(20, 'RawRecon', 0.8, 'MESE', 0.75, 'PDw', 0.85, NULL, NULL, '', NULL, NULL, NULL, 'anat', 'body_part:conflict,body_part:heuristic,contrast:low_confidence', false),
(21, 'RawRecon', 0.8, 'Unknown', 0.0, NULL, 0.5, NULL, NULL, '', NULL, NULL, NULL, 'misc', 'base:low_confidence,base:missing,body_part:low_confidence,contrast:low_confidence,technique:low_confidence', false),
(22, 'RawRecon', 0.8, 'SE', 0.95, 'T2w', 0.7, NULL, NULL, 'CompressedSensing,ParallelImaging,PartialFourier', NULL, NULL, NULL, 'anat', 'body_part:low_confidence,contrast:low_confidence', true)),
lines AS (SELECT concat_ws('.', l_orderkey, l_linenumber) AS stack_id, l_partkey % 23 AS protocol, l_quantity / 25 AS aspect, CAST(l_suppkey % 90 + 1 AS INTEGER) AS n_instances FROM lineitem),
c AS (SELECT stack_id, aspect, n_instances, provenance, CAST(provenance_confidence AS DOUBLE) AS provenance_confidence, technique, CAST(technique_confidence AS DOUBLE) AS technique_confidence, base,
    CAST(base_confidence AS DOUBLE) AS base_confidence, modifiers, constructs, accelerations, post_contrast, spinal_cord, excluded, intent,
    CASE WHEN stretches AND (aspect < 0.8 OR aspect > 1.25) AND n_instances < 80
        THEN array_to_string(list_sort(string_split(reasons || ',body_part:conflict,body_part:heuristic', ',')), ',') ELSE reasons END AS review_reasons FROM lines JOIN expected USING (protocol))"""


def _list(values: tuple) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + str(v).replace("'", "''") + "'" for v in values) + "]"


_K = "o_orderkey + o_custkey"
_AT = lambda values, key: f"({_list(values)})[{key} % {len(values)} + 1]"
_REV = f"r AS (SELECT o_orderkey AS stack_id, o_custkey AS subject_id, CAST(o_orderdate AS DATE) AS study_date, {_K} AS k, {_AT(_REASONS, f'({_K})')} AS reasons FROM orders)"
_DRAFT = "d AS (SELECT l_orderkey AS series_id, CASE WHEN l_linenumber = 1 THEN 'base' ELSE 'technique' END AS field, max(l_suppkey) AS draft_id, 'v' || (max(l_suppkey) % 5) AS v FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1, 2 HAVING max(l_suppkey) % 3 <> 0)"
_FLAG = lambda axis: f"CASE list_filter(string_split(coalesce(reasons, ''), ','), lambda x: x LIKE '{axis}:%')[1] WHEN '{axis}:missing' THEN 'missing' WHEN '{axis}:conflict' THEN 'conflict' WHEN '{axis}:low_confidence' THEN 'low_confidence' WHEN '{axis}:ambiguous' THEN 'ambiguous' WHEN '{axis}:odd' THEN 'review' END"
_STACKS = """s AS (SELECT concat_ws('.', l_orderkey, l_linenumber, l_suppkey, l_partkey) AS stack_id, l_orderkey * 3 + l_suppkey % 3 AS series_id, 'S' || (l_orderkey % 500) AS subject_code,
    CAST(l_shipdate AS DATE) AS study_date, l_linenumber - 1 AS stack_index, l_partkey + l_suppkey AS k FROM lineitem),
t AS (SELECT *, count(*) OVER (PARTITION BY series_id) > 1 AS several, ['anat', 'dwi', NULL][k % 3 + 1] AS intent, ['RawRecon', 'SyMRI', NULL, 'SWIRecon', 'EPIMix'][k % 5 + 1] AS provenance,
    CASE WHEN k % 4 <> 0 THEN lpad(CAST(k % 50 AS VARCHAR), 6, '0') ELSE 'zzz' END AS at_ FROM s)"""

_LISTED = """j AS (SELECT series_id, to_json(map(list(field ORDER BY field), list(v ORDER BY field)))::VARCHAR AS draft_changes FROM d GROUP BY 1),
member AS (SELECT c_custkey AS subject_id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2 OR (c_custkey % 7 = 0 AND (n_regionkey + 1) % 5 = 2)),
listed AS (SELECT stack_id, c_name AS subject_code, study_date, CASE WHEN k % 3 <> 0 THEN k % 7 END AS field_strength, ['GE', 'SIEMENS', NULL][k % 3 + 1] AS manufacturer, ['m1', 'm2'][k % 2 + 1] AS model,
    reasons AS review_reasons, draft_changes IS NOT NULL AS has_draft, draft_changes
    FROM r LEFT JOIN customer ON c_custkey = subject_id LEFT JOIN j ON series_id = stack_id
    WHERE (k % 17 = 0 OR subject_id IN (SELECT subject_id FROM member)) AND reasons <> ''
    AND ((k % 13 <> 0 AND k % 11 <> 0) OR regexp_matches(reasons, '(base|technique|modifier|provenance|construct):(missing|conflict)')))"""
_STORED = f"""SELECT 'o' || o_orderkey AS stack_id, {_AT(("T1w", None, "", "T2w", "Unknown"), f"({_K})")} AS base, {_AT(("TSE", None, "EPI", "", "MPRAGE", "RESOLVE", "Unknown"), f"({_K})")} AS technique,
    {_AT(("RawRecon", "SWIRecon", None, "DTIRecon", "SyMRI", "PerfusionRecon", "EPIMix", "Localizer", "RawRecon", "RawRecon", "RawRecon"), f"({_K})")} AS provenance,
    {_AT((None, "SWI,Phase", "", "QSM", "ADC,FA", "T1map", "CBF", None, "", None, "Other", None, None), f"({_K})")} AS constructs,
    {_AT(("anat", "anat", "dwi", "localizer", None, "excluded", "anat", "fmap"), f"(({_K}) // 2)")} AS intent, CAST({_AT((0, 0, None, 1), f"(({_K}) // 3)")} AS INTEGER) AS localizer,
    CAST({_AT((None, 0, 1), f"(({_K}) // 5)")} AS INTEGER) AS spinal_cord, CAST({_AT((None, 1, 0), f"(({_K}) // 7)")} AS INTEGER) AS post_contrast,
    CASE WHEN ({_K}) % 9 <> 0 THEN (({_K}) % 30)::DOUBLE / 12 END AS aspect, CASE WHEN ({_K}) % 8 <> 0 THEN CAST(({_K}) % 40 AS INTEGER) END AS n_instances FROM orders"""

ORACLE_SQL = {
    "classify_stacks": f"WITH {_EXPECTED} SELECT stack_id, aspect, n_instances, provenance, provenance_confidence, technique, technique_confidence, base, base_confidence, modifiers, constructs, accelerations, post_contrast, spinal_cord, excluded, intent, review_reasons FROM c",
    "classification_breakdown": f"WITH {_EXPECTED}, a AS (SELECT 'intent' AS axis, intent AS value FROM c UNION ALL SELECT 'base', base FROM c UNION ALL SELECT 'technique', technique FROM c UNION ALL SELECT 'provenance', provenance FROM c UNION ALL SELECT 'post_contrast', CAST(post_contrast AS VARCHAR) FROM c UNION ALL SELECT 'review', CASE WHEN review_reasons = '' THEN '0' ELSE '1' END FROM c) SELECT axis, value, count(*) AS n FROM a GROUP BY ALL",
    "review_reason_counts": f"WITH {_EXPECTED} SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(review_reasons, ',')) AS reason FROM c WHERE review_reasons <> '') GROUP BY reason",
    "qc_rule_violations": f"""WITH {_EXPECTED}, z AS ({_STORED}), y AS (
SELECT stack_id, base, technique, provenance, constructs, intent, CASE WHEN provenance = 'Localizer' THEN 1 ELSE 0 END AS localizer, spinal_cord, post_contrast, aspect, n_instances FROM c UNION ALL SELECT * FROM z),
x AS (SELECT *, coalesce(constructs, '') AS con, coalesce(provenance, '') AS prov, coalesce(intent, '') AS folder, coalesce(localizer, 0) = 1 AS scout, coalesce(base, '') AS b, coalesce(technique, '') AS t FROM y)
SELECT stack_id, 'technique_family_mismatch' AS rule, 'error' AS severity FROM x
    WHERE (prov = 'SWIRecon' AND t IN ('TSE', 'EPI')) OR (t = 'TSE' AND (con LIKE '%SWI%' OR con = 'QSM')) -- of the techniques dealt, TSE is of the SE family, EPI of EP; RESOLVE may be any
UNION ALL SELECT stack_id, 'technique_missing', 'warning' FROM x WHERE NOT scout AND folder NOT IN ('localizer', 'excluded') AND prov NOT IN ('SyMRI', 'SWIRecon', 'DTIRecon') AND t = '' AND b <> ''
UNION ALL SELECT stack_id, 'brain_aspect_ratio_anomaly', 'warning' FROM x WHERE folder = 'anat' AND spinal_cord IS DISTINCT FROM 1 AND NOT scout AND (aspect > 1.4::DOUBLE OR aspect < 0.7::DOUBLE)
UNION ALL SELECT stack_id, 'spine_aspect_ratio_anomaly', 'warning' FROM x WHERE spinal_cord = 1 AND aspect < 1.3::DOUBLE
UNION ALL SELECT stack_id, 'localizer_slice_count', 'warning' FROM x WHERE scout AND n_instances > 20
UNION ALL SELECT stack_id, 'non_localizer_low_slices', 'info' FROM x WHERE NOT scout AND folder = 'anat' AND n_instances < 10
UNION ALL SELECT stack_id, 'provenance_construct_mismatch', 'warning' FROM x WHERE con <> '' AND CASE prov WHEN 'SWIRecon' THEN NOT regexp_matches(con, '(?i)swi|qsm|phase|magnitude|m(in)?ip')
    WHEN 'DTIRecon' THEN NOT regexp_matches(con, '(?i)adc|fa|trace|md|ad|rd') WHEN 'SyMRI' THEN NOT regexp_matches(con, '(?i)t[12]map|pdmap|myelin|synthetic') WHEN 'PerfusionRecon' THEN NOT regexp_matches(con, '(?i)cb[fv]|mtt|tmax|ttp') ELSE false END
UNION ALL SELECT stack_id, 'contrast_undetermined', 'info' FROM x WHERE folder = 'anat' AND b = 'T1w' AND post_contrast IS NULL
UNION ALL SELECT stack_id, 'base_missing', 'warning' FROM x WHERE NOT scout AND folder = 'anat' AND con = '' AND prov NOT IN ('SyMRI', 'SWIRecon', 'DTIRecon', 'PerfusionRecon') AND b = ''""",
    "intent_synthesis": f"""
WITH x AS (SELECT o_orderkey AS stack_id, {_AT(_BASES, f'({_K})')} AS base, string_split(coalesce({_AT(_CONSTRUCTS, f'({_K})')}, ''), ',') AS c, {_AT(_PROVENANCES, f'({_K})')} AS p, {_AT(_TEXTS, f'({_K})')} AS t, {_AT(_TECHNIQUES, f'({_K})')} AS q FROM orders)
SELECT stack_id, CASE WHEN p = 'Localizer' THEN 'localizer' WHEN p = 'DTIRecon' THEN 'dwi' WHEN p = 'ASLRecon' THEN 'perf' WHEN p = 'BOLDRecon' THEN 'func'
    WHEN list_has_any(c, ['ADC', 'AD']) THEN 'dwi' WHEN list_contains(c, 'CBF') THEN 'perf' WHEN list_contains(c, 'B0map') THEN 'fmap'
    WHEN c = ['PhaseMap'] AND p <> 'SWIRecon' THEN 'fmap' WHEN c = ['InPhase', 'OutPhase'] THEN 'fmap'
    WHEN t = 'resting state epi' OR (t IN ('bold tse', 'task-motor') AND q = 'GRE-EPI') THEN 'func'
    WHEN base = 'DWI' THEN 'dwi' WHEN base = 'PWI' THEN 'perf' WHEN base IS NOT NULL THEN 'anat'
    WHEN list_has_any(c, ['MinIP', 'Fat', 'T1map', 'SyntheticT1w', 'SWIProcessed']) THEN 'anat' WHEN p IN ('SWIRecon', 'SyMRI', 'ProjectionDerived') THEN 'anat' ELSE 'misc' END AS intent FROM x""",
    "acceleration_regex": r"""
WITH x AS (SELECT doc_id, lower(coalesce(text, '') || ['', ' grappa', ' mb3 t2', '_cs_ csf', ' 7/8', ' the number twist', ' combat', ' arc[2x1]', ' caipi pf', ' sms_x', ' fse_arc'][doc_id % 11 + 1]) AS t,
    coalesce([NULL, 'cmrr_ep', 'fldyn3d', 'tse'][doc_id % 4 + 1], '') AS s FROM documents),
w AS (SELECT doc_id, s, regexp_replace(t, '[^\x00-\x7F]', 'x', 'g') AS t FROM x), -- letters to this engine's word boundaries too
y AS (SELECT *, replace(replace(t, 'csf', ' '), 'csa', ' ') AS c, regexp_replace(t, 'combat|ambig|membrane|chamber|number|symbol|assembly|climbing|plumb', ' ', 'g') AS m FROM w)
SELECT doc_id, array_to_string(list_filter([
    CASE WHEN regexp_matches(c, 'compressed.sensing|compressedsense|sparse|caipi|\bcs\[|_cs_|_cs\b') THEN 'CompressedSensing' END,
    CASE WHEN regexp_matches(t, 'grappa|sense|asset|ipat|speedup|accelerat|\barc\b|_arc_|_arc\b') THEN 'ParallelImaging' END,
    CASE WHEN regexp_matches(t, 'partial[ _]fourier|half[ -]?fourier|\bpf\b|[567]/8') THEN 'PartialFourier' END,
    CASE WHEN regexp_matches(m, 'multib|hyperband|\bmb\d|\bmb\[|\bmb=|_mb\d|_mb_|\bsms\b|_sms_|_sms\b') OR s = 'cmrr_ep' THEN 'SimultaneousMultiSlice' END,
    CASE WHEN regexp_matches(t, 'twist|tricks|keyhole|view ?sharing|disco|4d-?trak|time-resolved|differential subsampling') OR s = 'fldyn3d' THEN 'ViewSharing' END], lambda v: v IS NOT NULL), ',') AS accelerations FROM y""",
    "acquisition_type_inference": f"""
WITH x AS (SELECT o_orderkey AS stack_id, {_K} AS k FROM orders),
y AS (SELECT stack_id, CASE WHEN k % 4 = 3 THEN ['', 'already_set'] WHEN k % 19 = 0 THEN ['3D', 'unified_flag'] WHEN k % 23 = 0 THEN ['2D', 'unified_flag'] WHEN (k // 4) % 4 = 1 THEN ['3D', 'text_pattern']
    WHEN (k // 4) % 4 = 2 THEN ['2D', 'text_pattern'] WHEN (k // 3) % 3 = 1 THEN ['3D', 'technique_inference'] WHEN (k // 3) % 3 = 0 THEN ['2D', 'technique_inference'] ELSE ['', 'unknown'] END AS v FROM x)
SELECT stack_id, nullif(v[1], '') AS acquisition_type, v[2] AS method FROM y""",
    "technique_compatibility": f"""
WITH x AS (SELECT o_orderkey AS stack_id, ({_K}) % 10 AS q, (({_K}) // 10) % 7 AS t FROM orders)
SELECT stack_id, CASE WHEN q IN (0, 1) OR t IN (3, 4) THEN true WHEN t IN (2, 6) THEN q IN (5, 8) WHEN t IN (0, 5) THEN q IN (2, 3, 4, 7, 8, 9) ELSE q IN (2, 3, 6, 7, 8, 9) END AS fits FROM x""",
    "qc_categorise_priority": f"""
WITH {_REV}, m(reasons, category, priority) AS (VALUES ('base:missing', 'base', 2), ('base:missing', 'axes', 2),
    ('technique:conflict,base:low_confidence', 'base', 4), ('technique:conflict,base:low_confidence', 'technique', 4), ('technique:conflict,base:low_confidence', 'axes', 4),
    ('bodypart:spine_detected,contrast:low_confidence', 'body_part', 1), ('bodypart:spine_detected,contrast:low_confidence', 'contrast', 1),
    ('provenance:ambiguous,technique:odd', 'provenance', 2), ('provenance:ambiguous,technique:odd', 'technique', 2), ('provenance:ambiguous,technique:odd', 'axes', 2),
    ('base:low_confidence,base:missing', 'base', 3), ('base:low_confidence,base:missing', 'axes', 3))
SELECT stack_id, category, priority FROM r JOIN m USING (reasons)""",
    "qc_axis_flags": f"WITH {_REV} SELECT stack_id, " + ", ".join(f"{_FLAG(a)} AS {a}_flag" for a in qc.AXES) + " FROM r",
    "qc_available_filters": "SELECT * FROM (VALUES ('axis', 'base'), ('axis', 'technique'), ('axis', 'provenance'), ('flag', 'missing'), ('flag', 'conflict'), ('flag', 'low_confidence'), ('flag', 'ambiguous'), ('flag', 'review')) v(kind, value)",
    "qc_worklist": f"""
WITH {_REV}, {_DRAFT}, {_LISTED} SELECT stack_id, subject_code, study_date, field_strength, manufacturer, review_reasons, has_draft, draft_changes FROM listed WHERE review_reasons LIKE '%base:%'
ORDER BY subject_code NULLS LAST, study_date NULLS LAST, field_strength DESC NULLS LAST, manufacturer NULLS LAST, model, stack_id LIMIT 500 OFFSET 100""",
    "qc_worklist_flags": f"""
WITH {_REV}, {_DRAFT}, {_LISTED} SELECT 'base:missing' AS asked, stack_id, review_reasons, has_draft FROM listed WHERE review_reasons LIKE '%base:missing%'
UNION ALL SELECT 'technique:conflict', stack_id, review_reasons, has_draft FROM listed WHERE review_reasons LIKE '%technique:conflict%'
UNION ALL SELECT 'any:low_confidence', stack_id, review_reasons, has_draft FROM listed WHERE regexp_matches(review_reasons, '(base|technique|modifier|provenance|construct):low_confidence')
UNION ALL SELECT 'any:any', stack_id, review_reasons, has_draft FROM listed WHERE regexp_matches(review_reasons, '(base|technique|modifier|provenance|construct):')""",
    "qc_confirm_drafts": f"""
WITH {_REV}, {_DRAFT}, w AS (SELECT series_id AS stack_id, max(v) FILTER (field = 'base') AS b, max(v) FILTER (field = 'technique') AS t FROM d GROUP BY 1),
l AS (SELECT r.*, b, t, CASE WHEN b IS NULL AND t IS NULL THEN reasons ELSE nullif(array_to_string(list_filter(string_split(reasons, ','), lambda x: NOT ((b IS NOT NULL AND x LIKE 'base:%') OR (t IS NOT NULL AND x LIKE 'technique:%'))), ','), '') END AS kept FROM r LEFT JOIN w USING (stack_id))
SELECT stack_id, coalesce(b, 'T1w') AS base, coalesce(t, 'TSE') AS technique, 'FLAIR' AS modifiers,
    CASE WHEN coalesce(reasons, '') = '' THEN 0 WHEN (b IS NOT NULL OR t IS NOT NULL) AND kept IS NULL THEN 0 ELSE 1 END AS review_required, kept AS review_reasons FROM l""",
    "export_plan": f"""
WITH {_STACKS}, f AS (SELECT *, CASE WHEN provenance = 'SyMRI' THEN 'anat/SyMRI' WHEN provenance = 'SWIRecon' THEN 'anat' ELSE coalesce(intent, 'misc') END AS folder,
    CASE WHEN k % 7 = 0 THEN 'SC_' ELSE '' END AS spine, concat_ws('_', ['Ax', 'Obl', NULL, 'Sag'][k % 4 + 1], ['T1w', NULL, 'T2w'][k % 3 + 1], ['3D', NULL][k % 2 + 1], [NULL, 'FLAIR-FatSat'][k % 2 + 1],
        ['TSE', NULL, 'MPRAGE', 'GRE', NULL][k % 5 + 1], [NULL, 'ParallelImaging'][k % 2 + 1], [NULL, NULL, 'ADC-FA'][k % 3 + 1]) AS parts FROM t),
n AS (SELECT *, (CASE WHEN parts = '' THEN CASE WHEN spine = '' THEN 'unknown' ELSE 'SC' END ELSE spine || parts END) || (CASE WHEN k % 5 = 0 THEN '_CE' ELSE '' END)
    || (CASE WHEN several AND k % 4 = 1 THEN '_e' || (stack_index + 1) WHEN several AND k % 4 = 2 THEN '_ti' || (stack_index + 1) ELSE '' END) AS base_name FROM f),
u AS (SELECT *, CASE WHEN count(*) OVER w > 1 THEN base_name || '_' || row_number() OVER (PARTITION BY subject_code, study_date, folder, base_name ORDER BY at_, stack_index, stack_id) ELSE base_name END AS name
    FROM n WINDOW w AS (PARTITION BY subject_code, study_date, folder, base_name)),
p AS (SELECT stack_id, folder, 'sub-' || subject_code || '/ses-' || strftime(study_date, '%Y%m%d') || '/' || folder || '/' || name AS path FROM u)
SELECT *, path IN (SELECT 'sub-S' || (l_orderkey % 500) || '/ses-19980101/dwi/T1w_3D_TSE' FROM lineitem) AS skip FROM p""",
    "resolved_sources": """
WITH x AS (SELECT o_orderkey AS stack_id, o_custkey AS c, 'P' || o_custkey || '/' || o_orderkey AS folder FROM orders)
SELECT stack_id, CASE WHEN c % 7 = 0 THEN '/abs/' || folder WHEN c % 11 <> 0 THEN folder END AS path,
    CASE WHEN c % 7 = 0 THEN '/abs/' || folder WHEN c % 11 = 0 THEN NULL WHEN c % 3 = 1 THEN '/raw/sub-' || folder ELSE '/raw/' || folder END AS source,
    c % 7 <> 0 AND c % 11 <> 0 AND c % 3 <> 2 AS found FROM x""",
    "export_filters": f"WITH {_STACKS} SELECT intent, provenance, count(*) AS n FROM t WHERE coalesce(intent, 'misc') IN ('anat', 'misc') AND coalesce(provenance, '') NOT IN ('SWIRecon', 'EPIMix', 'ProjectionDerived', 'RawRecon') GROUP BY ALL",
}
