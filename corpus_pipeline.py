"""The corpus pipeline: language ID, near duplicates, decontamination, mixing, sharding.

STAGES are applied in order; each takes (spark, docs, sf_dir) and what it returns is written
as Parquet and read again as the next one's docs. All but the last return the columns of
documents. Rows without a doc_id end at the first stage. Ids may be repeated: a stage numbers
its rows when it starts and decides and acts on each row alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom.llm import language
from stackloom.llm.decontaminate import find_leaks
from stackloom.llm.mixing import mix_sources
from stackloom.llm.near_dup import near_duplicates
from stackloom.llm.sharding import kd_shards
from stackloom.llm.tables import broadcast_if_small, materialize, table

#: A text with letters is rejected only if less than this share of it is known in any language.
LEAST_COVERAGE = 0.1


#: The number of a row within its stage.
ROW = "__row"


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with ROW: a row's file and place in it, so that texts are not written once more;
    rows that do not come straight from whole files, each read once, are written with numbers."""
    try:
        placed = docs.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__place"))
    except AnalysisException:
        placed = None
    if placed is not None:
        files = placed.groupBy("__file").agg(F.count("*").alias("n"), F.max("__place").alias("last")).collect()
        if files and all(f.n == f.last + 1 for f in files):
            names = docs.sparkSession.createDataFrame([(f, i << 40) for i, f in enumerate(sorted(x["__file"] for x in files))], "__file string, __first long")
            return placed.join(broadcast_if_small(names, 300, len(files)), "__file").select(*(placed[c] for c in docs.columns), (F.col("__first") + F.col("__place")).alias(ROW))
    return materialize(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Numbered docs without the rows whose number is in rows(ROW), and without the numbers."""
    gone = materialize(rows.select(F.col(ROW).alias("gone")).distinct(), "gone")
    return docs.join(broadcast_if_small(gone, 16), docs[ROW] == gone["gone"], "left_anti").drop(ROW)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is recognised. Those that go have no letter, or
    hardly an n-gram of any learned language. If no document is labelled nothing is learned
    and none can be rejected for coverage."""
    docs = _numbered(docs).filter("doc_id is not null")
    model = language.train(docs.filter(~language.held_out(F.col("doc_id"))))
    guesses = language.predict(docs, model, id_col=ROW)
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if not model.langs:
        return docs.filter(lettered).drop(ROW)
    rejected = guesses.filter((F.col("lang_pred") == language.UNKNOWN) | (F.col("coverage") < LEAST_COVERAGE))
    return _without(docs, rejected)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near duplicates (five
    words, similarity 0.8), and one row of it where it is repeated. Documents without words
    are kept: they repeat nothing. A row without a doc_id stays only if its group has no other."""
    docs = _numbered(docs)
    groups = materialize(near_duplicates(docs, id_col=ROW, words=5, percent=80).select(ROW, "component_id"), "groups")
    shared = groups.filter(F.col(ROW) != F.col("component_id")).select("component_id").distinct()
    members = groups.join(shared, "component_id").join(docs.select(ROW, "doc_id"), ROW)
    members = materialize(members.select("component_id", F.struct(F.col("doc_id").isNull(), "doc_id", ROW).alias("place")), "members")
    first = members.groupBy("component_id").agg(F.min("place").alias("place"))
    return _without(docs, members.select(f"place.{ROW}").join(first.select(f"place.{ROW}"), ROW, "left_anti"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    docs = _numbered(docs)
    return _without(docs, find_leaks(docs, table(spark, sf_dir, "benchmark"), id_col=ROW))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: not at all, once or repeatedly."""
    columns = docs.columns
    docs = _numbered(docs)
    copies = mix_sources(docs, row_col=ROW).select(F.col(ROW).alias("taken_row"), F.col("copies").alias("__copies")).filter("__copies > 0")
    taken = docs.join(copies, docs[ROW] == copies["taken_row"])
    return taken.select(*(docs[c] for c in columns), F.explode(F.array_repeat(F.lit(0), F.col("__copies").cast("int"))).alias("__copy")).drop("__copy")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document of the mix, copies of one text side by side."""
    return kd_shards(docs, shards=8)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Language ID, SimHash and the k-d tree have no SQL form; tests hold stages to brute force.
ORACLE_SQL = None
