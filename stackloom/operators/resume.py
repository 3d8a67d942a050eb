"""De-identification runs that go on where one ended, and the renaming of folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackloom.streaming.ingest import _shared

FULL, OUTPUT_ONLY, SKIP = "full", "output_only", "skip"


def leaf_modes(files: DataFrame, audited: DataFrame, outputs: DataFrame) -> DataFrame:
    """(leaf, path, study_uid, audit_done, mode) of each file of a run that resumes.

    files(leaf, path, output, study_uid): the files in the order of their paths, where each would be written,
    and the study it says it is of (null: it says nothing). audited(study_uid) are studies whose
    audit an earlier run has stored; outputs(path) is a listing of what is there. A leaf is of
    the study that the first of its files with a study names, and that is known from that file
    on. Where the study's audit is stored a file is skipped if its output is there, and only
    written if not. Elsewhere the first file of the leaf is processed in full, for the audit, and
    the others are skipped or only written. Null leaves are one leaf; repeated rows of a path
    are treated alike. All of it is one aggregate by leaf and joins.
    """
    named = F.when(F.col("study_uid").isNotNull(), F.struct("path", "study_uid"))
    leaves = files.groupBy(F.col("leaf").alias("__leaf")).agg(F.min("path").alias("__first"), F.min(named).alias("__named"))
    leaves = leaves.select("__leaf", "__first", F.col("__named.path").alias("__from"), F.col("__named.study_uid").alias("__study"))
    done = audited.select(F.col("study_uid").alias("__study")).dropna().distinct().withColumn("__audited", F.lit(True))
    leaves = leaves.join(done, "__study", "left")
    there = outputs.select(F.col("path").alias("output")).distinct().withColumn("__there", F.lit(True))
    rows = files.join(leaves, F.col("leaf").eqNullSafe(F.col("__leaf")), "left").join(there, "output", "left")
    known = F.coalesce(F.col("path") >= F.col("__from"), F.lit(False))
    audit_done = known & F.col("__audited").isNotNull()
    again = F.when(F.col("__there").isNotNull(), SKIP).otherwise(OUTPUT_ONLY)
    mode = F.when(~audit_done & (F.col("path") == F.col("__first")), FULL).otherwise(again)
    return rows.select("leaf", "path", F.when(known, F.col("__study")).alias("study_uid"), audit_done.alias("audit_done"), mode.alias("mode"))


def leaf_summary(modes: DataFrame) -> DataFrame:
    """(leaf, n_files, n_full, n_output_only, n_skip, leaf_skipped): leaf_skipped tells whether the audit
    of a leaf was there already, so that no file of it is read in full."""
    counts = [F.count_if(F.col("mode") == m).alias(f"n_{m}") for m in (FULL, OUTPUT_ONLY, SKIP)]
    return modes.groupBy("leaf").agg(F.count("*").alias("n_files"), *counts, F.max("audit_done").alias("leaf_skipped"))


def _replaced(names: DataFrame, mapping: DataFrame) -> DataFrame:
    """(name, new_name) after all replacements, longest old text first, each applied to what those
    before it have made; only names that change.

    A name's parts are looked up in the mapping by equality, so names and mapping are never
    crossed. A round applies the next replacement of every name; there are as many rounds as one
    name has replacements, and each is written, so that the plan does not grow.
    """
    spark = names.sparkSession
    root = _shared(spark, None)
    by_length = Window.partitionBy("old").orderBy("new")
    rules = mapping.filter("old <> '' AND new <> '' AND old <> new").withColumn("__n", F.row_number().over(by_length)).filter("__n = 1")
    rules = rules.select("old", "new", F.struct(-F.length("old"), F.col("old")).alias("rank"))
    lengths = [r[0] for r in rules.select(F.length("old")).distinct().collect()]  # a few numbers
    at = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("current") - n + 1, F.lit(1))), lambda i: F.substring(F.col("current"), i, F.lit(n)))
    state = names.select("name", F.col("name").alias("current"), F.lit(None).cast("struct<col1:int,old:string>").alias("rank"))
    turn = 0
    while lengths:
        parts = F.explode(F.array_distinct(F.flatten(F.array(*map(at, lengths)))))
        met = state.select("name", "current", F.col("rank").alias("__done"), parts.alias("old")).join(rules, "old").filter("__done IS NULL OR rank > __done")
        nearest = met.groupBy("name", "current").agg(F.min(F.struct("rank", "old", "new")).alias("r"))
        moved = nearest.select("name", F.expr("replace(current, r.old, r.new)").alias("current"), F.col("r.rank").alias("rank"))
        moved.write.parquet(f"{root}/names-{turn}")
        state = spark.read.schema(moved.schema).parquet(f"{root}/names-{turn}")
        if state.isEmpty():
            break
        turn += 1
    if not turn:
        return names.select("name", F.col("name").alias("new_name")).limit(0)
    rounds = [spark.read.parquet(f"{root}/names-{i}").select("name", F.lit(i).alias("turn"), "current") for i in range(turn)]
    every = rounds[0]
    for part in rounds[1:]:
        every = every.union(part)
    return every.groupBy("name").agg(F.max(F.struct("turn", "current")).alias("r")).select("name", F.col("r.current").alias("new_name")).filter("name <> new_name")


def rename_plan(directories: DataFrame, mapping: DataFrame) -> DataFrame:
    """(path, depth, new_name, status) of the folders whose own name holds a text of mapping(old, new).

    directories(path) lists all folders, relative, with slashes. Deeper folders are renamed before
    those they lie in (order by depth from the largest). A folder is not renamed, status
    `target exists`, if a folder of the new name lies beside it, or if several would get it and
    it is not the first by name. Null paths and empty names are left out; of an old text with
    several new ones the smallest counts.
    """
    split = directories.select("path").dropna().distinct().withColumn("__parts", F.split("path", "/"))
    rows = split.select("path", F.size("__parts").alias("depth"), F.element_at("__parts", -1).alias("name"), F.array_join(F.slice("__parts", F.lit(1), F.size("__parts") - 1), "/").alias("parent")).filter("name <> ''")
    changed = rows.join(_replaced(rows.select("name").distinct(), mapping), "name")
    taken = rows.select("parent", F.col("name").alias("new_name"), F.lit(True).alias("__taken"))
    first = changed.groupBy("parent", "new_name").agg(F.min("name").alias("__first"))
    found = changed.join(taken, ["parent", "new_name"], "left").join(first, ["parent", "new_name"])
    clash = F.col("__taken").isNotNull() | (F.col("name") != F.col("__first"))
    return found.select("path", "depth", "new_name", F.when(clash, "target exists").otherwise("rename").alias("status"))


def renamed_paths(files: DataFrame, plan: DataFrame) -> DataFrame:
    """(path, new_path) of files(path) once a plan is carried out: every folder above a file takes its new name."""
    parts = F.split("path", "/")
    above = files.select("path", F.posexplode(F.slice(parts, F.lit(1), F.size(parts) - 1)).alias("i", "name"))
    prefix = F.array_join(F.slice(parts, F.lit(1), F.col("i") + 1), "/")
    chosen = plan.filter("status = 'rename'").select(F.col("path").alias("__folder"), F.col("new_name").alias("__new"))
    joined = above.withColumn("__folder", prefix).join(chosen, "__folder", "left")
    folders = joined.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("__new", "name").alias("name")))).alias("r"))
    kept = files.select("path").distinct().join(folders, "path", "left")
    return kept.select("path", F.array_join(F.concat(F.coalesce(F.transform("r", lambda x: x["name"]), F.array().cast("array<string>")), F.array(F.element_at(parts, -1))), "/").alias("new_path"))
