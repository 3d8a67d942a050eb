"""Audit and manifest files: a Python data source that writes CSV parts and commits them at once.

Tasks write their rows to parts under a name of the attempt. Only when all have ended does the driver
move the parts to their final names and write MANIFEST.csv, one line for each part with rows,
bytes and sha-256; a folder without it holds nothing. If a task fails for good, the parts that
were written are deleted and no manifest appears. The parts' contents and names depend on the
rows and their partitions alone, so a rerun gives the same manifest.
"""

from __future__ import annotations

import csv
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

NAME = "MANIFEST.csv"
FIELDS = ("part", "rows", "bytes", "sha256")


def _place(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))


@dataclass
class Part(WriterCommitMessage):
    number: int
    written: str
    rows: int
    bytes: int
    sha256: str


class ManifestWriter(DataSourceWriter):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path.rstrip("/"), columns

    def write(self, iterator: Iterator) -> Part:
        context = TaskContext.get()
        number = context.partitionId() if context else 0
        system, base = _place(self.path)
        system.create_dir(base, recursive=True)
        name, digest, rows, size = f".part-{number:05d}-{uuid.uuid4().hex[:12]}", hashlib.sha256(), 0, 0
        with system.open_output_stream(f"{base}/{name}") as out:

            def put(values) -> None:
                nonlocal size
                text = io.StringIO()
                csv.writer(text, lineterminator="\n").writerow(["" if v is None else v for v in values])
                data = text.getvalue().encode()
                digest.update(data)
                size += len(data)
                out.write(data)

            put(self.columns)
            for row in iterator:
                put(row)
                rows += 1
        return Part(number, name, rows, size, digest.hexdigest())

    def commit(self, messages: list[Part | None]) -> None:
        system, base = _place(self.path)
        system.create_dir(base, recursive=True)
        parts = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.number)
        for m in messages:  # a part without rows is no part
            if m is not None and not m.rows:
                system.delete_file(f"{base}/{m.written}")
        for m in parts:
            system.move(f"{base}/{m.written}", f"{base}/part-{m.number:05d}.csv")
        lines = [",".join(FIELDS)] + [f"part-{m.number:05d}.csv,{m.rows},{m.bytes},{m.sha256}" for m in parts]
        with system.open_output_stream(f"{base}/.{NAME}") as out:
            out.write(("\n".join(lines) + "\n").encode())
        system.move(f"{base}/.{NAME}", f"{base}/{NAME}")

    def abort(self, messages: list[Part | None]) -> None:
        """Delete what the tasks that ended have written, and parts of those that did not."""
        from pyarrow import fs

        system, base = _place(self.path)
        for info in system.get_file_info(fs.FileSelector(base, allow_not_found=True)):
            if info.base_name.startswith((".part-", f".{NAME}")):
                system.delete_file(info.path)


class ManifestSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "manifest"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return ManifestWriter(self.options["path"], list(schema.names))


def write_manifest(rows: DataFrame, path: str, order: list[str]) -> None:
    """Write rows as CSV parts with a manifest into a new folder. order sorts the rows of a part; for a
    rerun to give the same parts, rows must be partitioned by their values (repartition by a key)."""
    rows.sparkSession.dataSource.register(ManifestSource)
    rows.sortWithinPartitions(*order).write.format("manifest").mode("append").save(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of a folder: part, rows, bytes, sha256."""
    return spark.read.csv(f"{path}/{NAME}", header=True, schema="part string, rows long, bytes long, sha256 string")


def verified(spark: SparkSession, path: str) -> DataFrame:
    """The manifest with `intact`: whether the part is there with these bytes and this digest. Parts are
    read in tasks, piece by piece."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _place(path)
        for batch in batches:
            found = []
            for part, size, want in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                digest, n = hashlib.sha256(), 0
                try:
                    with system.open_input_stream(f"{base}/{part}") as raw:
                        while piece := raw.read(1 << 20):
                            digest.update(piece)
                            n += len(piece)
                except FileNotFoundError:
                    n = -1
                found.append(n == size and digest.hexdigest() == want)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.bool_())], [*FIELDS, "intact"])

    return manifest(spark, path).mapInArrow(check, "part string, rows long, bytes long, sha256 string, intact boolean")


def read_parts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all parts that the manifest lists; empty texts are null."""
    parts = [f"{path}/{r.part}" for r in manifest(spark, path).select("part").collect()]  # one name for each task of the writer
    if not parts:
        return spark.createDataFrame([], schema)
    return spark.read.csv(parts, header=True, schema=schema, multiLine=True, escape='"')


def archive_members(packed: DataFrame, group: str, name: str, size: str, content: Column | None = None, digest: Column | None = None) -> DataFrame:
    """(group, chunk, member, bytes, sha256) of packed items (pack_ffd) for an archive's manifest; content
    is what the digest is of. Large contents are digested before they are packed: give the digest then."""
    if digest is None:
        digest = F.sha2(content, 256) if content is not None else F.lit(None).cast("string")
    return packed.select(group, "chunk", F.col(name).alias("member"), F.col(size).alias("bytes"), digest.alias("sha256"))
