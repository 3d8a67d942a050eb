"""Review and export of classified stacks: rules, names, audit merges and votes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    id: str
    severity: str
    violated: str  # a condition in SQL that Spark shares with other engines


_ANAT = "intent = 'anat'"
_EMPTY = "coalesce({0}, '') = ''"
_HERE = "coalesce(localizer, 0) <> 1"
_LOWER = "lower(coalesce(constructs, ''))"
_NOT_FROM = "coalesce(provenance, '') NOT IN ({0})"
#: The families that a rule knows of techniques, and the constructs that it expects of provenances.
SE_TECHNIQUES = ("TSE", "SPACE", "BLADE", "PROPELLER", "HASTE", "Multi-echo SE", "IR-TSE", "STIR", "FLAIR", "DIR")
EP_TECHNIQUES = ("EPI", "DWI-EPI", "BOLD-EPI", "Perfusion-EPI")
EXPECTED = {
    "SWIRecon": ("swi", "qsm", "phase", "magnitude", "minip", "mip"),
    "DTIRecon": ("adc", "fa", "trace", "md", "ad", "rd", "eadc"),
    "SyMRI": ("t1map", "t2map", "pdmap", "myelin", "synthetic"),
    "PerfusionRecon": ("cbf", "cbv", "mtt", "tmax", "ttp"),
}
_SE, _EP = (", ".join(f"'{t}'" for t in x) for x in (SE_TECHNIQUES, EP_TECHNIQUES))
_UNEXPECTED = " OR ".join(f"(provenance = '{p}' AND NOT (" + " OR ".join(f"contains({_LOWER}, '{w}')" for w in words) + "))" for p, words in EXPECTED.items())
#: The rules in their order, with their bounds.
RULES = (
    Rule("technique_family_mismatch", "error", f"(provenance = 'SWIRecon' AND technique IN ({_SE}, {_EP})) OR (technique IN ({_SE}) AND (contains({_LOWER}, 'swi') OR contains({_LOWER}, 'qsm')))"),
    Rule("technique_missing", "warning", f"{_HERE} AND coalesce(intent, '') NOT IN ('localizer', 'excluded') AND {_NOT_FROM.format("'SyMRI', 'SWIRecon', 'DTIRecon'")} AND {_EMPTY.format('technique')} AND NOT {_EMPTY.format('base')}"),
    Rule("brain_aspect_ratio_anomaly", "warning", f"{_ANAT} AND coalesce(spinal_cord, 0) <> 1 AND {_HERE} AND (aspect > 1.4 OR aspect < 0.7)"),
    Rule("spine_aspect_ratio_anomaly", "warning", "spinal_cord = 1 AND aspect < 1.3"),
    Rule("localizer_slice_count", "warning", "localizer = 1 AND n_instances > 20"),
    Rule("non_localizer_low_slices", "info", f"{_HERE} AND {_ANAT} AND n_instances < 10"),
    Rule("provenance_construct_mismatch", "warning", f"{_LOWER} <> '' AND ({_UNEXPECTED})"),
    Rule("contrast_undetermined", "info", f"{_ANAT} AND base = 'T1w' AND post_contrast IS NULL"),
    Rule("base_missing", "warning", f"{_HERE} AND {_ANAT} AND {_EMPTY.format('constructs')} AND {_NOT_FROM.format("'SyMRI', 'SWIRecon', 'DTIRecon', 'PerfusionRecon'")} AND {_EMPTY.format('base')}"),
)


def violations(rows: DataFrame, keep: list[str], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each violated rule: keep, rule, severity. A condition that is null holds not.

    rows(base, technique, provenance, constructs, intent, localizer, spinal_cord, post_contrast, aspect, n_instances)."""
    found = [F.when(F.expr(r.violated), F.struct(F.lit(r.id).alias("rule"), F.lit(r.severity).alias("severity"))) for r in rules]
    return rows.select(*keep, F.explode(F.array_compact(F.array(*found))).alias("v")).select(*keep, "v.rule", "v.severity")


def unique_names(rows: DataFrame, scope: list[str], name: str, order: list[Column], out: str = "unique_name") -> DataFrame:
    """Names that several rows of a scope share are numbered name_1, name_2, ...; others stay."""
    same = Window.partitionBy(*scope, name)
    number = F.row_number().over(same.orderBy(*order))
    return rows.withColumn(out, F.when(F.count("*").over(same) > 1, F.concat_ws("_", name, number)).otherwise(F.col(name)))


def merge_audit(events: DataFrame, keys: list[str], order: str, old: str, new: str) -> DataFrame:
    """For each key the first non-empty old value and the last non-empty new value."""
    kept = lambda c: F.nullif(F.col(c), F.lit(""))
    first = F.min(F.when(kept(old).isNotNull(), F.struct(F.col(order).alias("at"), F.col(old).alias("value"))))["value"]
    last = F.max(F.when(kept(new).isNotNull(), F.struct(F.col(order).alias("at"), F.col(new).alias("value"))))["value"]
    return events.groupBy(*keys).agg(first.alias("old_value"), last.alias("new_value"))


def pivot_audit(merged: DataFrame, key: str, tag: str, names: dict[object, str]) -> DataFrame:
    """One row for each study, columns <name>_old_value and <name>_new_value of each listed tag.
    The list of tags bounds the width; filled_columns tells which columns have a value."""
    cells = []
    for value, name in names.items():
        for side in ("old_value", "new_value"):
            cells.append(F.max(F.when(F.col(tag) == F.lit(value), F.col(side))).alias(f"{name}_{side}"))
    return merged.groupBy(key).agg(*cells)


def filled_columns(wide: DataFrame, key: str) -> list[str]:
    """The columns of a pivot that some row fills, for writers that leave out empty ones: one
    aggregate over the table, one row to the driver."""
    columns = [c for c in wide.columns if c != key]
    filled = wide.agg(*(F.count(c).alias(c) for c in columns)).first()
    return [c for c in columns if filled[c]]


def majority_pair(rows: DataFrame, group: str, pair: list[str], least: int = 2) -> DataFrame:
    """The most common pair of each group with at least `least` rows; ties by the pair's order."""
    counted = rows.dropna(subset=pair).groupBy(group, *pair).agg(F.count("*").alias("votes")).filter(F.col("votes") >= least)
    best = Window.partitionBy(group).orderBy(F.desc("votes"), *pair)
    return counted.withColumn("__r", F.row_number().over(best)).filter("__r = 1").drop("__r")


def evidence_confidence(rows: DataFrame, group: str, source: str, weight: str) -> DataFrame:
    """Largest weight, 0.05 more for each further kind of source, 0.99 at most."""
    raised = F.max(weight) + 0.05 * (F.count_distinct(source) - 1)
    return rows.groupBy(group).agg(F.least(F.lit(0.99), raised).alias("confidence"))


def recovered_date(rows: DataFrame, key: str, dates: list[Column]) -> DataFrame:
    """The first date of the ranked sources that any row of a key has; then the earliest."""
    ranked = F.posexplode(F.array(*dates)).alias("rank", "date")
    return rows.select(key, ranked).filter("date is not null").groupBy(key).agg(F.min(F.struct("rank", "date")).alias("b")).select(key, F.col("b.date").alias("recovered"), F.col("b.rank").alias("source_rank"))
