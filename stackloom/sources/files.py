"""Listings of image files: tasks list them, nothing is opened."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom.streaming.ingest import _shared

# What each mode takes for an image file, by the file's name.
MODES = {"dcm": r"\.dcm$", "DCM": r"\.DCM$", "all_dcm": r"(?i)\.dcm$", "no_ext": r"^[^.]+$", "all": r"(?i)(\.dcm$|^[^.]+$)"}


def matches(name: Column, mode: str = "all") -> Column:
    """Whether a file's name fits a mode: one of MODES."""
    return name.rlike(MODES[mode])


#: Roots that tasks list with pyarrow: no patterns, and nothing that a URI would have to escape.
_PLAIN_ROOT = re.compile(r"(file|hdfs|s3[an]?|gs)://?[^*?\[\]{}\\%#\s]*$")
_BARE_ROOT = re.compile(r"/[^*?\[\]{}\\%#\s:]*$")
_LISTED = "path string, bytes long, modified long, folder boolean"


def qualified(spark: SparkSession, root: str) -> str:
    """The root with the scheme that Spark reads it by, if it is a path without one; other roots as they are."""
    if not _BARE_ROOT.match(root):
        return root
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(path).toString()
    return re.sub(r"^file:/(?!/)", "file:///", whole)


def _lister(root: str):
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, top = fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", root))
        prefix = re.sub(r"^file:///", "file:/", root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():  # as told from the root, which is empty
                at = system.get_file_info(top + folder)
                found = [at] if at.is_file else system.get_file_info(fs.FileSelector(top + folder))
                # As Spark's readers have it: hidden names and empty files are none.
                found = [f for f in found if f is at or not (re.match(r"\.|_[^=]*$", f.base_name) or f.base_name.endswith("._COPYING_"))]
                found = [f for f in found if f.type == fs.FileType.Directory or f.size]
                for i in range(0, len(found), 10_000):
                    rows = [(prefix + f.path[len(top) :], f.size, f.mtime_ns // 1_000_000 if f.mtime_ns else None, f.type == fs.FileType.Directory) for f in found[i : i + 10_000]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["path", "bytes", "modified", "folder"])

    return look


def _walked(spark: SparkSession, root: str) -> DataFrame:
    """(path, bytes, modified) of all files below root, level by level: the folders of a level are a table in
    the shared folder, which tasks list. The driver gets their number alone."""
    root = root.rstrip("/")
    at, levels, length = _shared(spark, None), [], len(re.sub(r"^file:///", "file:/", root))
    folders, n = spark.createDataFrame([("",)], "folder string"), 1
    while n:
        tasks = min(n, max(spark.sparkContext.defaultParallelism, -(-n // 100)))
        levels.append(f"{at}/level-{len(levels)}")
        folders.repartition(tasks).mapInArrow(_lister(root), _LISTED).write.parquet(levels[-1])
        folders = spark.read.schema(_LISTED).parquet(levels[-1]).filter("folder").select(F.substring("path", length + 1, 1 << 30))
        n = folders.count()
    return spark.read.schema(_LISTED).parquet(*levels).filter("not folder").select("path", "bytes", F.timestamp_millis("modified").alias("modified"))


def list_files(spark: SparkSession, root: str, mode: str = "all") -> DataFrame:
    """(path, relative, subject, leaf, name, bytes, modified) of the image files below root, at any
    depth. subject is the first folder below root, null for files right in it; leaf is the file's
    own folder. Listing runs in tasks, one for some folders of a level, when this is called; contents are
    not read. Only roots that pyarrow does not open, or that are patterns, are listed by Spark itself,
    which holds the whole list on the driver."""
    root = qualified(spark, root)
    base = root.rstrip("/") + "/"
    if _PLAIN_ROOT.match(root):
        listed = _walked(spark, root)
    else:
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    tail = base.split("://", 1)[-1].lstrip("/")
    relative = F.element_at(F.split("path", "(?:^|/)" + "".join("\\" + c if not c.isalnum() else c for c in tail), 2), -1)
    parts = F.split(F.col("relative"), "/")
    rows = listed.withColumn("relative", relative).withColumn("name", F.element_at(parts, -1)).filter(matches(F.col("name"), mode))
    leaf = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")
    return rows.select("path", "relative", F.when(F.size(parts) > 1, parts[0]).alias("subject"), leaf.alias("leaf"), "name", "bytes", "modified")


def by_leaf(files: DataFrame, partitions: int) -> DataFrame:
    """The files of one folder in one partition, in order of their names."""
    return files.repartition(partitions, "leaf").sortWithinPartitions("leaf", "name")


def source_statistics(files: DataFrame) -> DataFrame:
    """One row: folders, files, subjects and bytes."""
    return files.agg(F.count_distinct("leaf").alias("n_folders"), F.count("*").alias("n_files"), F.count_distinct("subject").alias("n_subjects"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def split_relative(path: Column) -> tuple[Column, Column]:
    """(first segment, the rest) of a relative path; backslashes count as slashes."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/", 2)
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
