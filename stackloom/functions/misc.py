"""Small readings of header values: vendors, tracers, echo numbers, flags, sizes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a maker's name holds, the tracers, and the units of sizes.
VENDORS = (("SIEMENS", ("SIEMENS",)), ("GE", ("GE", "GENERAL ELECTRIC")), ("PHILIPS", ("PHILIPS",)), ("CANON", ("CANON", "TOSHIBA")), ("HITACHI", ("HITACHI",)))
UNITS = {"": 1, "b": 1, "kb": 10**3, "mb": 10**6, "gb": 10**9, "tb": 10**12, "kib": 2**10, "mib": 2**20, "gib": 2**30, "tib": 2**40}


def vendor(maker: Column) -> Column:
    """The vendor that a maker's name tells, OTHER for any other name and for none."""
    upper = F.upper(F.coalesce(maker, F.lit("")))
    has = lambda words: reduce(lambda a, b: a | b, (upper.contains(w) for w in words))
    return F.coalesce(*(F.when(has(words), name) for name, words in VENDORS), F.lit("OTHER"))


def echo_number(raw: Column) -> Column:
    """The whole number before the first comma; null if there is none."""
    return F.floor(F.trim(F.get(F.split(raw, ","), F.lit(0))).try_cast("double")).cast("int")


def calcium_score(modality: Column, text: Column) -> Column:
    """For CT 1 or 0, whether the wording is that of a calcium score; null for other modalities."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(modality == "CT", (low.contains("calcium") | low.contains("cascore")).cast("int"))


def attenuation_corrected(modality: Column, method: Column) -> Column:
    """For PT 1 if an attenuation correction is named, else 0; null for other modalities."""
    return F.when(modality.isin("PT", "PET"), (F.coalesce(F.trim(method), F.lit("")) != "").cast("int"))


def size_bytes(text: Column) -> Column:
    """A size such as `1.5 GiB` in bytes, a plain number as it is; null if it is no size."""
    cleaned = F.replace(F.lower(F.trim(text)), F.lit(" "), F.lit(""))
    number = F.regexp_extract(cleaned, r"^([0-9]+(?:\.[0-9]+)?)([a-z]*)$", 1).try_cast("double")
    unit = F.regexp_extract(cleaned, r"^([0-9]+(?:\.[0-9]+)?)([a-z]*)$", 2)
    factor = F.coalesce(*(F.when(unit == u, F.lit(float(n))) for u, n in UNITS.items()))
    return (number * factor).cast("long")


def size_text(size: Column) -> Column:
    """Bytes as text with two decimals of the largest binary unit that fits."""
    steps = (("TiB", 2**40), ("GiB", 2**30), ("MiB", 2**20), ("KiB", 2**10))
    return F.coalesce(*(F.when(size >= n, F.format_string(f"%.2f {u}", size / float(n))) for u, n in steps), F.concat(size.cast("string"), F.lit(" B")))


def mean_confidence(confidences: Column, default: float = 0.8) -> Column:
    """The mean of an array of confidences; the default for an empty or null one."""
    total = F.aggregate(confidences, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.coalesce(F.size(confidences), F.lit(0)) > 0, total / F.size(confidences)).otherwise(F.lit(default))


def best_candidate(candidates: Column) -> Column:
    """struct(best, others) of an array of structs (value, confidence): the most confident, ties
    by value, and the rest in that order; null for an empty array."""
    ranked = F.array_sort(candidates, lambda a, b: F.when(a["confidence"] > b["confidence"], -1).when(a["confidence"] < b["confidence"], 1).when(a["value"] < b["value"], -1).when(a["value"] > b["value"], 1).otherwise(0))
    return F.when(F.size(candidates) > 0, F.struct(F.get(ranked, F.lit(0)).alias("best"), F.slice(ranked, 2, F.greatest(F.size(ranked) - 1, F.lit(1))).alias("others")))


def ambiguous(best: Column, others: Column, gap: float = 0.1) -> Column:
    """Whether another candidate comes within a gap of the best."""
    return F.coalesce(best["confidence"] - F.array_max(F.transform(others, lambda x: x["confidence"])) < gap, F.lit(False))


#: The folders that an outcome may name.
INTENTS = ("anat", "dwi", "func", "fmap", "perf", "localizer", "misc", "excluded")


def outcome_errors(intent: Column, base: Column, constructs: Column, post_contrast: Column, spinal_cord: Column, localizer: Column, reasons: Column) -> Column:
    """What is wrong with a stored outcome, an array of texts."""
    tri = lambda c, name: F.when(c.isNotNull() & ~c.isin(0, 1), F.concat(F.lit(f"Invalid {name} value: "), c.cast("string")))
    bare = (localizer == 0) & (intent != "excluded") & base.isNull() & (F.coalesce(constructs, F.lit("")) == "")
    bad = F.filter(F.split(F.coalesce(reasons, F.lit("")), ","), lambda r: (r != "") & ~r.contains(":"))
    fixed = F.array_compact(F.array(F.when(bare, "Non-localizer must have base or construct"), F.when(~intent.isin(*INTENTS), F.concat(F.lit("Invalid directory_type: "), intent)), tri(post_contrast, "post_contrast"), tri(spinal_cord, "spinal_cord")))
    return F.concat(fixed, F.transform(bad, lambda r: F.concat(F.lit("Invalid review reason format: "), r)))
