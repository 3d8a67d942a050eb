"""Quality control of classified stacks: categories, priorities, axis flags, worklists, drafts.

Review reasons are a CSV of `axis:problem`. Everything here is a Column over that CSV or a join
of the cache with its drafts; null and empty CSVs have no reasons.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a reason holds or begins with, by category and axis, in their order.
CATEGORIES = {
    "base": ("base:",),
    "provenance": ("provenance:",),
    "technique": ("technique:",),
    "body_part": ("body_part:", "bodypart:", "spine", "heuristic:"),
    "contrast": ("contrast:",),
    "modifier": ("modifier:",),
    "construct": ("construct:",),
    "axes": ("base:", "technique:", "modifier:", "provenance:", "construct:"),
}
AXES = ("base", "technique", "modifier", "provenance", "construct")
AXIS_COLUMNS = {"base": "base", "technique": "technique", "modifier": "modifiers", "provenance": "provenance", "construct": "constructs"}
FLAGS = ("missing", "conflict", "low_confidence", "ambiguous")
WEIGHTS = {"low_confidence": 1, "missing": 2, "conflict": 3, "ambiguous": 2}


def _reasons(csv: Column) -> Column:
    return F.filter(F.transform(F.split(F.lower(F.coalesce(csv, F.lit(""))), ","), lambda x: F.trim(x)), lambda x: x != "")


def categories(csv: Column, allowed: tuple[str, ...] = tuple(CATEGORIES)) -> Column:
    """The categories of an item, an array in the table's order."""
    text = F.lower(F.coalesce(csv, F.lit("")))
    return F.array_compact(F.array(*(F.when(reduce(lambda a, b: a | b, (text.contains(p) for p in CATEGORIES[c])), c) for c in CATEGORIES if c in allowed)))


def priority(csv: Column) -> Column:
    """How urgent an item is: each kind of problem adds its weight once."""
    return sum((F.when(F.coalesce(csv, F.lit("")).contains(word), weight).otherwise(0) for word, weight in WEIGHTS.items()), F.lit(0))


def flag_of(reason: Column) -> Column:
    """What kind of problem a reason names; `review` if it is none of the known ones."""
    return reduce(lambda c, f: F.when(reason.contains(f), f).otherwise(c), reversed(FLAGS), F.lit("review"))


def axis_flag(csv: Column, axis: str) -> Column:
    """The problem that the first reason of an axis names; null if the axis has none."""
    first = F.get(F.filter(_reasons(csv), lambda x: x.startswith(f"{axis}:")), F.lit(0))
    return F.when(first.isNotNull(), flag_of(first))


def available_filters(rows: DataFrame, csv: str) -> DataFrame:
    """(kind, value): the axes, and the flags, that some row's reasons have."""
    each = rows.select(F.explode(_reasons(F.col(csv))).alias("reason")).distinct()
    on_axis = each.filter(F.substring_index("reason", ":", 1).isin(*AXES) & F.col("reason").contains(":"))
    return on_axis.select(F.explode(F.array(F.struct(F.lit("axis").alias("kind"), F.substring_index("reason", ":", 1).alias("value")), F.struct(F.lit("flag").alias("kind"), flag_of(F.col("reason")).alias("value")))).alias("x")).select("x.*").distinct()


def has_flag(csv: Column, axis: str | None = None, flag: str | None = None) -> Column:
    """Whether any reason is one of the axis (null: of any axis) and has the flag (null: any). The
    reasons' case counts, and a reason may have more text before or behind."""
    return reduce(lambda a, b: a | b, (F.coalesce(csv, F.lit("")).contains(f"{a}:{flag or ''}") for a in ([axis] if axis else AXES)))


def worth_a_look(intent: Column, csv: Column) -> Column:
    """Localizers are looked at only for what is missing or in conflict; a stack without an
    intent is treated like them."""
    return F.coalesce(intent != "localizer", F.lit(False)) | has_flag(csv, flag="missing") | has_flag(csv, flag="conflict")


def worklist(cache: DataFrame, subjects: DataFrame, members: DataFrame, cohorts: DataFrame, drafts: DataFrame, cohort_id: int, axis: str | None = None, flag: str | None = None) -> DataFrame:
    """The stacks of a cohort that need a look at an axis, each once, with their drafts.

    A stack belongs to a cohort that it comes from by name, or of which its subject is a member.
    cache(stack_id, series_id, subject_id, origin, study_date, field_strength, manufacturer, model,
    intent, review_required, review_reasons, ...); drafts(series_id, field, new_value) are shown as
    one JSON object. The order is the caller's: WORKLIST_ORDER; worklist_page cuts a page.
    """
    name = cohorts.filter(F.col("cohort_id") == cohort_id).select(F.col("name").alias("__name"))
    listed = members.filter(F.col("cohort_id") == cohort_id).select("subject_id").distinct().withColumn("__member", F.lit(True))
    rows = cache.join(listed, "subject_id", "left").join(name, F.col("origin") == F.col("__name"), "left")
    rows = rows.filter(F.col("__member").isNotNull() | F.col("__name").isNotNull()).drop("__member", "__name")
    csv = F.col("review_reasons")
    rows = rows.filter((F.col("review_required") == 1) & has_flag(csv, axis, flag) & worth_a_look(F.col("intent"), csv))
    changes = drafts.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("field", "new_value"))).alias("d"))
    changes = changes.select("series_id", F.to_json(F.map_from_entries("d")).alias("draft_changes"))
    rows = rows.join(subjects.select("subject_id", "subject_code"), "subject_id", "left").join(changes, "series_id", "left")
    return rows.withColumn("has_draft", F.col("draft_changes").isNotNull())


#: Subject, date, field strength (strongest first), manufacturer, model, stack; nulls last.
WORKLIST_ORDER = ("subject_code", "study_date", "-field_strength", "manufacturer", "model", "stack_id")


def worklist_order() -> list[Column]:
    return [F.col(c[1:]).desc_nulls_last() if c[0] == "-" else F.col(c).asc_nulls_last() for c in WORKLIST_ORDER]


def worklist_page(listed: DataFrame, offset: int = 0, limit: int = 100) -> tuple[DataFrame, int]:
    """A page of a worklist in its order, and the number of items in all."""
    return listed.orderBy(*worklist_order()).offset(offset).limit(limit), listed.count()


def confirm_drafts(cache: DataFrame, drafts: DataFrame, key: str = "series_id") -> DataFrame:
    """The cache with its drafts pushed: the drafted axes take the new values, their reasons go,
    and review_required becomes 0 where no reason is left. Drafts of other fields, and rows
    without drafts, change nothing. Of several drafts of one field the last by id counts."""
    fields = {c: a for a, c in AXIS_COLUMNS.items()}
    last = drafts.filter(F.col("field").isin(*fields)).groupBy(key).agg(*(F.max(F.when(F.col("field") == c, F.struct("draft_id", "new_value"))).alias(f"__{c}") for c in fields))
    joined = cache.join(last, key, "left")
    touched = F.array_compact(F.array(*(F.when(F.col(f"__{c}").isNotNull(), f"{a}:") for c, a in fields.items())))
    left = F.filter(F.split("review_reasons", ","), lambda r: ~F.exists(touched, lambda p: F.startswith(F.lower(F.trim(r)), p)))
    reasons = F.when(F.size(touched) == 0, F.col("review_reasons")).otherwise(F.nullif(F.array_join(left, ","), F.lit("")))
    required = F.when((F.size(touched) > 0) & (F.coalesce(reasons, F.lit("")) == ""), F.lit(0)).otherwise(F.col("review_required"))
    new = {c: F.when(F.col(f"__{c}").isNotNull(), F.col(f"__{c}.new_value")).otherwise(F.col(c)) for c in fields}
    return joined.withColumns({**new, "review_required": required, "review_reasons": reasons}).select(*cache.columns)
