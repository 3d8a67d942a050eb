"""Imports of CSV files: reading, coercion with warnings, and dry-run plans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom.functions.dicom import birth_date, first_float, first_integer, flatten_list
from stackloom.operators.upsert import assign_ids


@dataclass(frozen=True)
class Field:
    """A field of an import: the column it comes from, its default, and its parser, one of
    string, int, float, bool and date."""

    name: str
    column: str | None = None
    default: str | None = None
    parser: str = "string"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header: all columns as text, names trimmed, a byte-order mark dropped,
    quoted line ends kept. Rows are numbered from 1 within a file, in its order."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").csv(path)
    return rows.toDF(*(c.lstrip("﻿").strip() for c in rows.columns))


def parsed(text: Column, parser: str) -> Column:
    """A text by a parser; null where it cannot be parsed."""
    raw, low = F.trim(text), F.lower(F.trim(text))
    if parser == "int":
        return F.when(raw.rlike(r"^[+-]?[0-9]+$"), raw.try_cast("long"))
    if parser == "float":
        return raw.try_cast("double")
    if parser == "bool":
        number = low.try_cast("double")
        return F.when(low.isin("1", "true", "t", "yes", "y"), 1).when(low.isin("0", "false", "f", "no", "n"), 0).when(number.isNotNull(), (number != 0).cast("int"))
    return birth_date(raw) if parser == "date" else raw


def coerced(rows: DataFrame, fields: list[Field], number: str = "row_number") -> DataFrame:
    """(number, a column for each field, warnings): blank texts take the default, blank defaults
    are null, and a text that its parser refuses is null with a warning `Row n: field`."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    out, warnings = [], []
    for f in fields:
        column = f.column if f.column in rows.columns else (f.column or "").strip()  # names may come with blanks around them
        raw = blank(F.col(column)) if column in rows.columns else F.lit(None).cast("string")
        raw = F.coalesce(raw, blank(F.lit(f.default)) if f.default is not None else F.lit(None).cast("string"))
        value = parsed(raw, f.parser)
        out.append(value.alias(f.name))
        warnings.append(F.when(raw.isNotNull() & value.isNull(), F.concat(F.lit("Row "), F.col(number), F.lit(f": cannot parse {f.name}"))))
    return rows.select(number, *out, F.array_compact(F.array(*warnings)).alias("warnings"))


def last_rows(rows: DataFrame, key: str, number: str = "row_number") -> DataFrame:
    """Of the rows of one key the last; rows without a key are dropped."""
    others = [c for c in rows.columns if c != key]
    return rows.filter(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").groupBy(key).agg(F.max_by(F.struct(*others), number).alias("r")).select(key, "r.*")


def import_plan(existing: DataFrame, incoming: DataFrame, key: str, columns: list[str], skip_blank: bool = True) -> DataFrame:
    """What an import would do, without doing it: (key, action, columns) with action inserted,
    updated or skipped (no column changes). With skip_blank a null does not overwrite."""
    old = existing.select(key, *(F.col(c).alias(f"__old_{c}") for c in columns), F.lit(True).alias("__there"))
    joined = incoming.select(key, *columns).join(old, key, "left")
    new = {c: F.coalesce(F.col(c), F.col(f"__old_{c}")) if skip_blank else F.col(c) for c in columns}
    changes = F.array_contains(F.array(*(~new[c].eqNullSafe(F.col(f"__old_{c}")) for c in columns)), True)
    action = F.when(F.col("__there").isNull(), "inserted").when(changes, "updated").otherwise("skipped")
    return joined.select(key, action.alias("action"), *(new[c].alias(c) for c in columns))


def cohort_rows(rows: DataFrame, name: str = "name") -> DataFrame:
    """(key, name): cohorts by their trimmed lower-case name; the first spelling by row number stays."""
    trimmed = F.trim(name)
    return rows.filter(F.coalesce(trimmed, F.lit("")) != "").groupBy(F.lower(trimmed).alias("key")).agg(F.min_by(trimmed, "row_number").alias("name"))


def subject_codes(rows: DataFrame, patient: str, subject: str) -> DataFrame:
    """(old_id, new_id) of a table of subject codes, each patient once; texts are trimmed.

    Rows where both are blank do not count. A row with one of them blank, and a patient with two
    different codes, make the table unusable: a ValueError says how many there are and names one.
    """
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    pairs = rows.select(blank(patient).alias("old_id"), blank(subject).alias("new_id")).filter("old_id IS NOT NULL OR new_id IS NOT NULL")
    table = pairs.groupBy("old_id").agg(F.min("new_id").alias("new_id"), F.max("new_id").alias("__other"), F.count_if(F.col("new_id").isNull()).alias("__blank"))
    bad = table.agg(
        F.count_if(F.col("old_id").isNull()).alias("no_patient"), F.count_if(F.col("old_id").isNotNull() & (F.col("__blank") > 0)).alias("no_code"), F.min(F.when(F.col("__blank") > 0, F.col("old_id"))).alias("blank_of"),
        F.count_if(F.col("old_id").isNotNull() & (F.col("new_id") != F.col("__other"))).alias("conflicts"), F.min(F.when(F.col("new_id") != F.col("__other"), F.col("old_id"))).alias("conflict_of"),
    ).first()
    if bad.no_patient:
        raise ValueError("a row of the subject codes has no patient id")
    if bad.no_code:
        raise ValueError(f"{bad.no_code} patients have a row without a subject code, such as {bad.blank_of}")
    if bad.conflicts:
        raise ValueError(f"{bad.conflicts} patients have conflicting subject codes, such as {bad.conflict_of}")
    return table.select("old_id", "new_id")


# The columns of an instance import by kind, and names that stand for others.
LISTS, INTEGERS = ("image_orientation_patient", "image_type", "echo_numbers"), ("echo_train_length", "pet_bed_index")
FLOATS, TEXTS = ("echo_time", "repetition_time", "flip_angle", "inversion_time", "kvp", "xray_exposure", "tube_current"), ("receive_coil_name", "pet_frame_type")
INSTANCE_ALIASES = {"echo_number": "echo_numbers"}
NOTHING = ("", "none", "null", "nan")


def instance_values(rows: DataFrame, key: str = "instance_id") -> DataFrame:
    """(key, the columns of an instance import that a CSV has), as the table's types: lists become
    backslash texts, numbers are taken out of lists, and what says nothing is null. Header names
    count without case and blanks around them. Rows without a key are left out."""
    names = {c.strip().lower(): c for c in rows.columns}
    if key not in names:
        raise ValueError(f"the file has no column {key}")
    known = {INSTANCE_ALIASES.get(n, n): c for n, c in sorted(names.items(), key=lambda x: x[0] not in INSTANCE_ALIASES)}
    out = []
    for kind, convert in ((LISTS, flatten_list), (INTEGERS, first_integer), (FLOATS, first_float), (TEXTS, lambda c: c)):
        for name in kind:
            if name in known:
                raw = F.trim(F.col(f"`{known[name]}`"))
                out.append(F.when(~F.lower(raw).isin(*NOTHING), convert(raw)).alias(name))
    if not out:
        raise ValueError("the file has none of the columns of an instance")
    return rows.withColumn("__key", F.nullif(F.trim(F.col(f"`{names[key]}`")), F.lit(""))).filter("__key IS NOT NULL").select(F.col("__key").try_cast("long").alias(key), *out)


def update_instances(instances: DataFrame, values: DataFrame, key: str = "instance_id") -> tuple[DataFrame, DataFrame]:
    """(instances with the imported columns replaced, nulls included, where the import has their key;
    one row with rows_processed and rows_updated). Of several rows of a key the largest counts; keys
    that no instance has change nothing."""
    columns = [c for c in values.columns if c != key]
    one = values.groupBy(key).agg(F.max(F.struct(*columns)).alias("__new"))
    joined = instances.join(one, key, "left")
    there = F.col("__new").isNotNull()
    out = joined.withColumns({c: F.when(there, F.col(f"__new.{c}")).otherwise(F.col(c) if c in instances.columns else F.lit(None)) for c in columns}).drop("__new")
    counts = values.agg(F.count("*").alias("rows_processed")).join(F.broadcast(instances.join(one.select(key), key, "left_semi").agg(F.count("*").alias("rows_updated"))))
    return out, counts


def upsert_cohorts(cohorts: DataFrame, incoming: DataFrame) -> DataFrame:
    """cohorts(cohort_id, name, owner, path, description, is_active) after incoming rows of the same
    columns but the id: names match without case and blanks, and are stored trimmed and lower-case. A known
    cohort takes owner, path and description, and is_active unless that is null; a new one gets the next
    id, and is active unless it says otherwise. Rows without a name, owner or path are left out; of
    several rows of one name the largest counts."""
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    fresh = incoming.select(F.lower(text("name")).alias("name"), text("owner").alias("owner"), text("path").alias("path"), text("description").alias("description"), "is_active").dropna(subset=["name", "owner", "path"])
    fresh = fresh.groupBy("name").agg(F.max(F.struct("owner", "path", "description", "is_active")).alias("r"))
    ids = assign_ids(cohorts.select(F.lower(F.trim("name")).alias("name"), F.col("cohort_id").cast("long").alias("cohort_id")), fresh.select("name"), "name", "cohort_id")
    old = cohorts.select(F.lower(F.trim("name")).alias("name"), *(F.col(c).alias(f"__{c}") for c in ("owner", "path", "description", "is_active")), F.col("name").alias("__name"))
    joined = ids.join(old, "name", "left").join(fresh, "name", "left")
    new = F.col("r").isNotNull()
    fields = {c: F.when(new, F.col(f"r.{c}")).otherwise(F.col(f"__{c}")) for c in ("owner", "path", "description")}
    active = F.coalesce(F.when(new, F.col("r.is_active")), F.col("__is_active"), F.lit(True))
    return joined.select("cohort_id", F.coalesce("__name", "name").alias("name"), *(v.alias(c) for c, v in fields.items()), active.alias("is_active"))


def create_id_types(types: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(types with the new ones, the rows refused): types(id, name, description). Names are trimmed and unique
    without case: a name that is there, or that comes twice (the smaller spelling stays), is refused, as are blank ones."""
    named = incoming.select(F.nullif(F.trim("name"), F.lit("")).alias("name"), F.nullif(F.trim("description"), F.lit("")).alias("description"))
    one = named.dropna(subset=["name"]).groupBy(F.lower("name").alias("key")).agg(F.min(F.struct("name", "description")).alias("r"), F.count("*").alias("n"))
    there = types.select(F.lower(F.trim("name")).alias("key"), F.col("id").cast("long").alias("id"))
    fresh = one.join(there, "key", "left_anti")
    ids = assign_ids(there, fresh.select("key"), "key", "id").join(fresh, "key")
    refused = one.join(there, "key", "left_semi").select("r.name", F.lit("name exists").alias("reason")).union(fresh.filter("n > 1").select("r.name", F.lit("name comes twice")))
    refused = refused.union(named.filter("name IS NULL").select("name", F.lit("name is blank")))
    return types.unionByName(ids.select("id", "r.name", "r.description")), refused


def list_id_types(types: DataFrame, identifiers: DataFrame) -> DataFrame:
    """(id, name, description, identifiers_count): every type with the number of identifiers(id_type_id) of it."""
    counts = identifiers.groupBy(F.col("id_type_id").alias("id")).agg(F.count("*").alias("__n"))
    return types.join(counts, "id", "left").select("id", "name", "description", F.coalesce("__n", F.lit(0)).alias("identifiers_count"))
