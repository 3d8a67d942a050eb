"""Checks after gap filling: orientations to review, contrast duplicates, references, SWI stacks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackloom.functions.geometry import field_strength
from stackloom.operators import gapfill, rules

#: Confidence of an orientation below which it is reviewed; what a signature holds.
ORIENTATION_CONFIDENCE = 0.85
SIGNATURE = ("base", "technique", "stack_orientation", "mr_te", "mr_tr")


def doubtful_orientation(modality: Column, confidence: Column) -> Column:
    """Whether an MR stack's orientation needs review; false where there is no confidence."""
    return F.coalesce((modality == "MR") & (confidence < ORIENTATION_CONFIDENCE), F.lit(False))


def contrast_duplicates(stacks: DataFrame) -> DataFrame:
    """Stacks of one session that look alike and have one contrast value: one of them should be
    taken before contrast and one after.

    Only stacks with a contrast value count, and of them those that are alone in their series.
    A missing part of the signature, an empty text and a zero are all alike. Stacks without
    subject, date or series are left out."""
    known = stacks.filter("post_contrast IS NOT NULL AND subject_id IS NOT NULL AND study_date IS NOT NULL AND series_instance_uid IS NOT NULL")
    alone = stacks.filter("post_contrast IS NOT NULL").groupBy("series_instance_uid").count().filter("count = 1").select("series_instance_uid")
    parts = (F.when(~F.col(c).cast("string").isin("", "0", "0.0"), F.col(c).cast("string")) for c in SIGNATURE)
    signed = known.join(alone, "series_instance_uid", "left_semi").withColumn("signature", F.concat_ws("|", *(F.coalesce(p, F.lit("")) for p in parts)))
    # Groups are counted and joined back, so that a frequent signature is no single task's work.
    session = ["subject_id", "study_date", "signature"]
    alike = signed.groupBy(*session).agg(F.count("*").alias("n_alike"), F.min("post_contrast").alias("low"), F.max("post_contrast").alias("high"))
    alike = alike.filter("n_alike > 1 AND low = high").select(*session, "n_alike")
    return signed.select("series_stack_id", *session, "post_contrast").join(alike, session)


def reference_stacks(cache: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Classified MR stacks that others may be filled from: base and technique known, not excluded."""
    known = cache.filter("base <> 'Unknown' AND technique <> 'Unknown' AND directory_type <> 'excluded'").select("series_stack_id", "base", "technique")
    physics = fingerprints.filter("modality = 'MR'").select("series_stack_id", "mr_tr", "mr_te", "mr_ti", "mr_flip_angle", "stack_n_instances")
    return known.join(physics, "series_stack_id")


def completed_review(reasons: Column, **flags: Column) -> Column:
    """Review reasons (comma-separated) with the named flags that hold, each once, in order."""
    held = F.filter(F.split(F.coalesce(reasons, F.lit("")), ","), lambda x: x != "")
    added = F.array(*(F.when(c, F.lit(name)) for name, c in flags.items()))
    return F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.concat(held, added)))), ",")



def normalised_strengths(details: DataFrame, key: str = "series_id", column: str = "magnetic_field_strength") -> DataFrame:
    """(key, old, new) of the rows whose field strength changes by more than 0.001 T when it is
    snapped: the update, without the rows that are right already."""
    old, new = F.col(column), field_strength(F.col(column))
    return details.select(key, old.alias("old"), new.alias("new")).filter(F.abs(F.col("old") - F.col("new")) > 0.001)


def load_for_classification(fingerprints: DataFrame, stacks: DataFrame, series: DataFrame) -> DataFrame:
    """Fingerprints with their stack's and series' columns; a fingerprint without either is left out."""
    beside = stacks.select("series_stack_id", "series_id", "stack_index", "stack_key")
    return fingerprints.join(beside, "series_stack_id").join(series.select("series_id", "series_instance_uid", "study_id"), "series_id")


def load_for_completion(cache: DataFrame, fingerprints: DataFrame, stacks: DataFrame, series: DataFrame, studies: DataFrame) -> DataFrame:
    """Classified stacks with all that the completion reads of fingerprint, stack, series and study."""
    beside = stacks.select("series_stack_id", "series_id", "stack_orientation_confidence")
    found = cache.join(fingerprints, "series_stack_id").join(beside, "series_stack_id")
    return found.join(series.select("series_id", "series_instance_uid", "study_id"), "series_id").join(studies.select("study_id", "study_date", "subject_id"), "study_id")


#: Provenances whose axes are not filled, and those that are not routed again.
NOT_FILLED = ("SyMRI", "SWIRecon", "EPIMix", "BOLDRecon")
NOT_ROUTED = ("SWIRecon", "SyMRI", "EPIMix")
# What tells the folder of a filled stack, in order: constructs, then bases, then provenances.
_FOLDERS = (("dwi", ("ADC", "eADC", "FA", "Trace", "MD", "AD", "RD")), ("perf", ("CBF", "CBV", "MTT", "Tmax", "TTP")), ("fmap", ("B0map", "PhaseMap", "B1map")))
_ANAT_BASES = ("T1w", "T2w", "PDw", "T2*w", "SWI", "MTw", "T1rho", "T2rho")
_ANAT_PROVENANCES = ("SWIRecon", "SyMRI", "ProjectionDerived", "SubtractionDerived")


def completed_intent(base: Column, constructs: Column, provenance: Column, localizer: Column) -> Column:
    """The folder of a stack whose axes were filled; misc if nothing tells one."""
    held = F.transform(F.split(F.coalesce(constructs, F.lit("")), ","), lambda x: F.trim(x))
    has = lambda names: F.arrays_overlap(held, F.array(*map(F.lit, names)))
    out = F.when(localizer == 1, "localizer").when(provenance == "DTIRecon", "dwi").when(provenance.isin("PerfusionRecon", "ASLRecon"), "perf").when(provenance == "BOLDRecon", "func")
    out = reduce(lambda c, x: c.when(has(x[1]), x[0]), _FOLDERS, out).when(base == "DWI", "dwi").when(base == "PWI", "perf")
    return out.when(base.isin(*_ANAT_BASES) | provenance.isin(*_ANAT_PROVENANCES), "anat").otherwise("misc")


def _says_2d_3d(stacks: DataFrame) -> tuple[Column, Column]:
    image, name = F.upper(F.coalesce("image_type", F.lit(""))), F.lower(F.coalesce("stack_sequence_name", F.lit("")))
    return image.contains("3D") | name.contains("3d") | name.contains("spc") | name.contains("space"), image.contains("2D") | name.contains("2d")


def _without(reasons: Column, *gone: Column) -> Column:
    """A list of reasons without the given ones (null: none)."""
    return F.array_except(reasons, F.array_compact(F.array(*gone)))


def completion_pass(stacks: DataFrame, references: DataFrame, key: str = "series_stack_id") -> DataFrame:
    """What the completion makes of stacks (load_for_completion) with the help of references
    (reference_stacks): the axes, folder, acquisition type and review reasons after all phases.

    The phases, each of which sees what those before it have done: doubtful orientations;
    acquisition types; base and technique by the vote of neighbours in physics bins; stacks
    that the vote makes SWI go through the SWI branch, which settles all their axes; the
    folder of those in misc; contrast duplicates. touched tells whether any phase has
    changed or flagged a stack: only these need to be written. fill is how the vote went (null: not
    asked). Nulls are absent values; rows that repeat a key are not expected.
    """
    is_3d, is_2d = _says_2d_3d(stacks)
    mr = F.coalesce(F.col("modality") == "MR", F.lit(False))
    told = gapfill.acquisition_type(F.col("mr_acquisition_type"), is_3d, is_2d, F.col("text_search_blob"), F.col("technique"))
    rows = stacks.withColumns({
        "__doubt": doubtful_orientation(F.col("modality"), F.col("stack_orientation_confidence")),
        "__type": F.when(mr, told["value"]),
        "__no_base": F.coalesce(F.col("base"), F.lit("")) == "",
        "__no_technique": F.coalesce(F.col("technique"), F.lit("Unknown")) == "Unknown",
    })
    wanting = mr & F.coalesce(F.col("directory_type") != "excluded", F.lit(True)) & ~F.coalesce(F.col("provenance").isin(*NOT_FILLED), F.lit(False)) & (F.col("__no_base") | (F.col("base") == "Unknown") | F.col("__no_technique"))
    rows = rows.withColumn("__asked", F.coalesce(wanting, F.lit(False)))

    physics = [F.col("mr_tr").alias("tr"), F.col("mr_te").alias("te"), F.col("mr_ti").alias("ti"), F.col("mr_flip_angle").alias("fa"), "stack_n_instances"]
    probes = gapfill.with_bins(rows.filter("__asked").select(key, "scanning_sequence", *physics), "stack_n_instances")
    known = gapfill.with_bins(references.select("base", "technique", *physics), "stack_n_instances")
    votes = gapfill.vote(probes, known, key).select(key, F.col("base").alias("__base"), F.col("technique").alias("__technique"), F.col("outcome").alias("__outcome"))
    rows = rows.join(votes, key, "left")
    unknown = F.col("__no_base") | (F.lower(F.trim("base")) == "unknown")
    fills_base, fills_technique = F.col("__no_base") & F.col("__base").isNotNull(), F.col("__no_technique") & F.col("__technique").isNotNull()
    routed = F.coalesce(F.when(unknown, F.col("__base")) == "SWI", F.lit(False)) & ~F.coalesce(F.col("provenance").isin(*NOT_ROUTED), F.lit(False))
    held = F.array_distinct(F.filter(F.transform(F.split(F.coalesce("manual_review_reasons_csv", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != ""))
    added = F.array_compact(F.array(F.when(fills_base, "base:low_confidence"), F.when(fills_technique, "technique:low_confidence")))
    reasons = F.array_union(_without(held, F.when(fills_base, "base:missing"), F.when(fills_technique, "technique:missing")), added)
    rows = rows.withColumns({
        "__routed": routed,
        "__reasons": reasons,
        "base": F.when(fills_base, F.col("__base")).otherwise(F.col("base")),
        "technique": F.when(fills_technique, F.col("__technique")).otherwise(F.col("technique")),
        "fill": F.when(F.col("__asked"), F.coalesce("__outcome", F.lit("no_match"))),
        "mr_acquisition_type": F.coalesce("__type", "mr_acquisition_type"),
        "touched": F.col("__doubt") | F.col("__type").isNotNull() | F.col("__asked"),
    })

    headers = {"image_type": "image_type", "scanning_sequence": "scanning_sequence", "sequence_variant": "sequence_variant", "scan_options": "scan_options", "stack_sequence_name": "sequence_name", "text_search_blob": "text"}
    again = rows.filter("__routed").select(key, *(F.col(c).alias(n) for c, n in headers.items()))
    swi = rules.branch_outcome(again, "swi").select(key, "routed_base", "routed_constructs", "routed_technique", "routed_intent")
    rows = rows.join(swi, key, "left")
    took = lambda new, old: F.when(F.col("__routed"), new).otherwise(F.col(old)).alias(old)
    settled = {"base": took(F.col("routed_base"), "base"), "technique": took(F.col("routed_technique"), "technique"), "construct_csv": took(F.col("routed_constructs"), "construct_csv"), "provenance": took(F.lit("SWIRecon"), "provenance"), "directory_type": took(F.col("routed_intent"), "directory_type")}
    rows = rows.withColumns(settled)
    folder = completed_intent(F.col("base"), F.col("construct_csv"), F.col("provenance"), F.col("localizer"))
    rows = rows.withColumn("directory_type", F.when((F.col("directory_type") == "misc") & F.col("touched"), folder).otherwise(F.col("directory_type")))

    alike = contrast_duplicates(rows).select(key, F.lit(True).alias("__alike"))
    rows = rows.join(alike, key, "left")
    flags = F.array_compact(F.array(F.when(F.col("__doubt"), "orientation:low_confidence"), F.when(F.col("__alike"), "contrast:duplicate_prediction")))
    touched = F.col("touched") | F.coalesce("__alike", F.lit(False))
    csv = F.array_join(F.array_sort(F.array_union("__reasons", flags)), ",")
    rows = rows.withColumns({"touched": touched, "manual_review_required": F.when(touched, 1).otherwise(F.col("manual_review_required")), "manual_review_reasons_csv": F.when(touched, csv).otherwise(F.col("manual_review_reasons_csv"))})
    return rows.select(*stacks.columns, "fill", "touched")


def review_ids(*flagged: DataFrame) -> DataFrame:
    """The distinct ids of stacks that any of the given tables flags."""
    return reduce(DataFrame.union, flagged).distinct()
