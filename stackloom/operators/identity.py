"""De-identification plans: new ids, tags to scrub, time points, and subject codes.

Ids of text are hashed by BLAKE2b, which Spark has no function for: one Arrow UDF over batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def keyed_hash(key: str, digest_size: int = 8):
    """A Column function: the hexadecimal keyed BLAKE2b of a text; null stays null."""

    @pandas_udf("string")
    def hashed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        secret = key.encode()
        for part in texts:
            yield part.map(lambda x: None if x is None else hashlib.blake2b(x.encode(), key=secret, digest_size=digest_size).hexdigest())

    return hashed


def plain_number(digits: int):
    """A Column function: a text's 4-byte BLAKE2b as a number below 10 ** digits."""

    @pandas_udf("long")
    def number(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield part.map(lambda x: None if x is None else int(hashlib.blake2b(x.encode(), digest_size=4).hexdigest(), 16) % 10**digits)

    return number


def width(pattern: str) -> int:
    return pattern.count("X") if "X" in pattern else 4


def from_pattern(pattern: str, number: Column) -> Column:
    """A pattern's run of X replaced by a number, padded to the run's length; appended if there is none."""
    n = width(pattern)
    padded = F.lpad(number.cast("string"), F.greatest(F.lit(n), F.length(number.cast("string"))), F.lit("0"))
    run = "X" * n
    return F.replace(F.lit(pattern), F.lit(run), padded) if run in pattern else F.concat(F.lit(pattern), padded)


def deterministic_id(old: Column, pattern: str, salt: str) -> Column:
    """The pattern with a salted hash of the old id in it."""
    return from_pattern(pattern, plain_number(width(pattern))(F.concat(F.lit(f"{salt}|"), old)))


def path_id(path: Column, depth: int, regex: str, pattern: str) -> Column:
    """An id from the path's segment at a depth (from 1): the regex's group, a number put into
    the pattern, or a text put in its place; null if the path is not that deep."""
    segment = F.get(F.split(path, "/"), F.lit(depth - 1))
    found = F.nullif(F.regexp_extract(segment, regex, 1), F.lit(""))
    token = F.coalesce(found, segment)
    run = "X" * width(pattern)
    put = F.replace(F.lit(pattern), F.lit(run), token) if run in pattern else F.concat(F.lit(pattern), token)
    return F.when(token.rlike("^[0-9]+$"), from_pattern(pattern, token.cast("long"))).otherwise(put)


def mapped_ids(rows: DataFrame, mapping: DataFrame, old: str, fallback: Column | None = None, out: str = "new_id") -> DataFrame:
    """rows with the new id that mapping(old_id, new_id) has for theirs; else the fallback, else
    the old id. Of several entries of one id the last in code-point order counts."""
    table = mapping.filter("coalesce(trim(old_id), '') <> ''").groupBy(F.trim("old_id").alias("__old")).agg(F.max(F.trim("new_id")).alias("__new"))
    joined = rows.join(table, F.col(old) == F.col("__old"), "left")
    return joined.withColumn(out, F.coalesce(F.nullif("__new", F.lit("")), fallback if fallback is not None else F.col(old), F.col(old))).drop("__old", "__new")


def sequential_ids(found: DataFrame, old: str, order: str, pattern: str, start: int = 1) -> DataFrame:
    """(old, new_id): distinct ids numbered by where they were first found. Ranges of the order
    are numbered apart and offset by the counts of those before, so no task gets all rows."""
    first = found.filter(F.col(old).isNotNull()).groupBy(old).agg(F.min(order).alias("__at"))
    ranged = first.repartitionByRange("__at", old).withColumn("__part", F.spark_partition_id())
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("__part").orderBy("__at", old))
    placed = ranged.withColumn("__own", own).join(F.broadcast(counts.withColumn("__before", before)), "__part")  # one row a partition
    return placed.select(old, from_pattern(pattern, F.col("__own") + F.col("__before") + (start - 1)).alias("new_id"))


def discovered_ids(files: DataFrame, mode: str) -> DataFrame:
    """Patient ids in files(path, study_uid, patient_id): `top` the first of each top folder by
    path, `study` the first of each study by path, `all` every one; each id once."""
    usable = files.filter("coalesce(patient_id, '') <> ''")
    if mode == "all":
        return usable.select("patient_id").distinct()
    if mode == "top":
        return usable.groupBy(F.split("path", "/")[0].alias("top")).agg(F.min_by("patient_id", "path").alias("patient_id")).select("patient_id").distinct()
    return usable.filter("study_uid is not null").groupBy("study_uid").agg(F.min_by("patient_id", "path").alias("patient_id")).select("patient_id").distinct()


def mapping_problems(mapping: DataFrame) -> DataFrame:
    """(problem, id) of what a subject mapping(old_id, new_id) must not hold: `conflict` an id with
    several codes, `code_missing` an id without one, `id_missing` a code (given as id) without an
    id. Blanks around ids and codes do not count; entries without both are none; each problem comes once."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit(""))
    entries = mapping.select(blank("old_id").alias("old"), blank("new_id").alias("new")).filter("old <> '' OR new <> ''")
    by_id = entries.filter("old <> ''").groupBy("old").agg(F.min(F.nullif("new", F.lit(""))).alias("low"), F.max("new").alias("high"), F.min("new").alias("least"))
    told = F.array_compact(F.array(F.when(F.col("low") != F.col("high"), "conflict"), F.when(F.col("least") == "", "code_missing")))
    found = by_id.select(F.explode(told).alias("problem"), F.col("old").alias("id"))
    return found.union(entries.filter("old = ''").select(F.lit("id_missing"), "new").distinct())


def _checked(mapping: DataFrame) -> DataFrame:
    """The mapping's entries, each id once; a problem fails the job that reads it."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit(""))
    say = lambda text, c: F.raise_error(F.concat(F.lit(f"subject mapping: {text} "), c)).cast("string")
    entries = mapping.select(blank("old_id").alias("o"), blank("new_id").alias("n")).filter("o <> '' OR n <> ''")
    # The id and the code are read by the join and the result, so neither check can be pruned.
    ids = entries.select(F.when(F.col("o") == "", say("no id for", F.col("n"))).otherwise(F.col("o")).alias("old_id"), "n")
    grouped = ids.groupBy("old_id").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    code = F.when(F.col("low") == "", say("no code for", F.col("old_id"))).when(F.col("low") != F.col("high"), say("several codes for", F.col("old_id"))).otherwise(F.col("high"))
    return grouped.select("old_id", code.alias("new_id"))


def resolved_subjects(rows: DataFrame, mapping: DataFrame, seed: str, digest_size: int = 8, strict: bool = True) -> DataFrame:
    """rows(patient_id, study_uid, ...) with subject_code and its source: the mapping's code
    (`csv`), else the keyed hash of the patient id, or of the study uid where that is missing
    (`hash`); both null where neither is there.

    An entry without an id or a code, or an id with several codes, fails the job (mapping_problems
    lists them); if not strict such an entry is left out, and of several codes the last in code-point
    order counts."""
    coded = mapped_ids(rows.withColumn("__none", F.lit(None).cast("string")), _checked(mapping) if strict else mapping, "patient_id", F.col("__none"), "__csv")
    known = F.col("__csv").isNotNull() & (F.col("__csv") != F.coalesce("patient_id", F.lit("")))
    key = F.coalesce(F.nullif("patient_id", F.lit("")), "study_uid")
    coded = coded.withColumn("subject_code", F.when(known, F.col("__csv")).otherwise(keyed_hash(seed, digest_size)(key)))
    return coded.withColumn("source", F.when(known, "csv").when(key.isNotNull(), "hash")).drop("__csv", "__none")


def months_apart(first: Column, date: Column) -> Column:
    """Whole months and days / 30.44 between two dates, rounded half-even."""
    early, late = F.least(first, date), F.greatest(first, date)
    apart = (F.year(late) - F.year(early)) * 12 + F.month(late) - F.month(early)
    whole = F.when(F.add_months(early, apart) > late, apart - 1).otherwise(apart)
    days = F.datediff(late, F.add_months(early, whole))
    return F.bround(whole + days / 30.44, 0).cast("int")


def month_label(months: Column) -> Column:
    """M00, M06, ...: months snapped to the nearest multiple of six if that is one month away at most."""
    six = F.greatest(F.lit(6), (6 * F.bround(months / 6, 0)).cast("int"))
    snapped = F.when(F.abs(months - six) <= 1, six).otherwise(months)
    return F.when(months == 0, "M00").otherwise(F.concat(F.lit("M"), F.lpad(snapped.cast("string"), F.greatest(F.lit(2), F.length(snapped.cast("string"))), F.lit("0"))))


def timepoint(first: Column, date: Column) -> Column:
    """The label of the months between two dates."""
    return month_label(months_apart(first, date))


def scrub_plan(tags: DataFrame, scrubbed: DataFrame, kept: tuple[str, ...]) -> DataFrame:
    """Events (path, tag, name, action, old_value) for tags(path, tag, name, value): a tag on the
    scrub list is `removed`, except kept ones and those whose name says uid, or reference and
    sequence, which are `retained`."""
    name = F.lower("name")
    spared = F.col("tag").isin(*kept) | name.contains("uid") | (name.contains("referenc") & name.contains("sequence"))
    hit = tags.join(scrubbed.select("tag").distinct(), "tag")
    return hit.select("path", "tag", "name", F.when(spared, "retained").otherwise("removed").alias("action"), F.col("value").alias("old_value"))


PATIENT_ID, STUDY_DATE, STUDY_UID = "0010,0020", "0008,0020", "0020,000D"
# The tags that every category of a de-identification removes, by group: numbers; MANDATORY always.
MANDATORY = {"0008": "0016 0018"}
CATEGORIES = {
    "Patient_Information": {"0010": "0010 0030 0032 0040 1010 1020 1030 1040 0050 1090 1080 1081 2000 2110 2150 2152 2154 2160 2180 21A0 21B0 21C0 21D0 1000 1001 1002 0101 0102 2297 2298 0021 1060 21F0 4000"},
    "Clinical_Trial_Information": {"0012": "0010 0020 0021 0030 0031 0040 0042 0050 0051 0060 0071 0072 0081 0082 0083 0084 0085 0086 0087 0088 0089 0090 0091"},
    "Healthcare_Provider_Information": {
        "0008": "0090 0092 0094 0096 1060 106E 1048 1049 1062 1050 1052 1070 1072 2111 1080",
        "0032": "1032 1033 1060",
        "0040": "1001 0007 0009 0006 000B 0254 0253 A075 A073 0275 0260 A730 1102 1103 1104 1002 1400",
        "0400": "0561",
        "0070": "0084 0086",
    },
    "Institution_Information": {"0008": "1010 0080 0081 1040 1041"},
    "Time_And_Date_Information": {"0008": "0021 0022 0023 0030 0031 0032 0033 0012 0013", "0032": "1050 1051", "0040": "0244 0245 0250 0251 2004 2005 A030 A032"},
}


def scrub_list(categories: tuple[str, ...] = tuple(CATEGORIES)) -> list[str]:
    """The tags, as group,number in upper case, that the given categories remove, sorted; unknown categories have none."""
    tables = [MANDATORY, *(CATEGORIES.get(c, {}) for c in categories)]
    return sorted({f"{group},{number}" for table in tables for group, numbers in table.items() for number in numbers.split()})


def audit_events(tags: DataFrame, ids: DataFrame, categories: tuple[str, ...] = tuple(CATEGORIES), kept: tuple[str, ...] = (), timepoints: bool = True) -> DataFrame:
    """(path, study_uid, tag, name, action, old_value, new_value): what de-identification does to each element.

    tags(path, tag, name, value) are the elements of all files. A patient id that ids(old_id, new_id) maps
    is replaced. A study date becomes its time point after the patient's first (replaced); where it is
    no date, or has no patient, or timepoints is off, it is retained. Listed tags of the categories
    are removed; ids, dates and the study's uid are not, nor kept tags, nor elements that say they
    are uids or references. Elements that nothing happens to give no event. Blank values count as missing.
    """
    value = F.nullif(F.trim("value"), F.lit(""))
    rows = tags.withColumn("value", value)
    own = rows.groupBy("path").agg(*(F.min(F.when(F.col("tag") == t, F.col("value"))).alias(n) for n, t in (("__patient", PATIENT_ID), ("study_uid", STUDY_UID), ("__date", STUDY_DATE))))
    own = own.withColumn("__day", F.when(F.col("__date").rlike(r"^\d{8}$"), F.try_to_date("__date", "yyyyMMdd")))
    # Tables of files and patients grow with the input, yet look small by the size of compressed files: none may be broadcast. Files
    # without a patient are dealt by their paths, behind a blank that no trimmed id begins with.
    table = ids.select(F.trim("old_id").alias("__key"), F.lit(None).cast("date").alias("__day"), F.trim("new_id").alias("__new"))
    patients = own.select(F.col("__patient").alias("__key"), "__day", F.lit(None).cast("string").alias("__new")).union(table)
    patients = patients.filter("__key IS NOT NULL").groupBy("__key").agg(F.min("__day").alias("__first"), F.max("__new").alias("__new"))
    files = own.withColumn("__key", F.coalesce("__patient", F.concat(F.lit(" "), "path"))).join(patients.hint("merge"), "__key", "left")
    # Months and labels are columns of the files: put into the actions, which repeat them, they make an expression that no compiler takes.
    label = F.when(F.col("__day").isNotNull(), month_label(F.col("__months"))) if timepoints else F.lit(None).cast("string")
    files = files.withColumn("__months", months_apart(F.col("__first"), F.col("__day"))).withColumn("__label", label)
    name = F.lower(F.coalesce("name", F.lit("")))
    spared = F.col("tag").isin(PATIENT_ID, STUDY_DATE, STUDY_UID, *kept) | name.contains("uid") | name.contains("referenc")
    listed = F.col("tag").isin(*scrub_list(categories)) & ~spared
    mapped = F.when((F.col("tag") == PATIENT_ID) & (F.col("__new") != F.col("value")), F.nullif("__new", F.lit("")))
    dated = (F.col("tag") == STUDY_DATE) & F.col("value").isNotNull()
    new = F.when(mapped.isNotNull(), mapped).when(dated & F.col("__patient").isNotNull(), F.col("__label"))
    action = F.when(mapped.isNotNull(), "replaced").when(dated, F.when(new.isNotNull(), "replaced").otherwise("retained")).when(listed, "removed")
    touched = rows.filter((F.col("tag") == PATIENT_ID) | dated | listed)  # no other element gives an event
    joined = touched.join(files.hint("merge"), "path").withColumns({"action": action, "new_value": F.when(action == "removed", "").otherwise(F.coalesce(new, F.lit("")))})
    return joined.filter("action IS NOT NULL").select("path", "study_uid", "tag", "name", "action", F.coalesce("value", F.lit("")).alias("old_value"), "new_value")
