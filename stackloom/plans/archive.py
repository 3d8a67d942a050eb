"""Image files written from a table into the shared folder, and their headers read back."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom.operators.packing import pack_ffd
from stackloom.plans.ingest import FFD
from stackloom.sources import files, headers, manifest
from stackloom.sources.elements import TAGS
from stackloom.streaming.ingest import _shared

#: What the files differ in, dealt by their number: character sets with their codecs, and transfer syntaxes.
_CHARSETS = (("ISO_IR 100", "latin_1"), ("ISO_IR 192", "utf_8"), ("", "latin_1"))
_SYNTAXES = (("1.2.840.10008.1.2.1", "<"), ("1.2.840.10008.1.2.2", ">"))


def _element(tag: int, kind: str, value: bytes, order: str = "<") -> bytes:
    value += (b"\0" if kind in ("UI", "SQ") else b" ") * (len(value) % 2)
    head = struct.pack(order + "HH", tag >> 16, tag & 0xFFFF) + kind.encode()
    return head + (b"\0\0" + struct.pack(order + "I", len(value)) if kind == "SQ" else struct.pack(order + "H", len(value))) + value


def _image(number: int, name: str) -> bytes:
    (charset, codec), (syntax, order) = _CHARSETS[number % 3], _SYNTAXES[number % 2]
    code = _element(0x00080100, "SH", str(number % 7).encode(), order)
    item = struct.pack(order + "HHI", 0xFFFE, 0xE000, len(code)) + code
    body = [_element(0x00080005, "CS", charset.encode(), order)] if charset else []
    body += [_element(TAGS["SOPInstanceUID"], "UI", f"1.2.{number}".encode(), order), _element(TAGS["PatientName"], "PN", f"Åberg^{name}".encode(codec), order), _element(TAGS["EchoTime"], "DS", f"{number % 50}.5".encode(), order)]
    body += [_element(TAGS["CTDIPhantomTypeCodeSequence"], "SQ", item, order), _element(TAGS["Rows"], "US", struct.pack(order + "H", number % 512), order)]
    meta = _element(TAGS["MediaStorageSOPClassUID"], "UI", b"1.2.840.10008.5.1.4.1.1.4") + _element(TAGS["TransferSyntaxUID"], "UI", syntax.encode())
    start = b"" if number % 5 == 0 else b"\0" * 128 + b"DICM"
    return start + meta + b"".join(body) + struct.pack(order + "HH", 0x7FE0, 0x0010) + b"OW\0\0" + b"\xff" * 4 + b"\0" * 64


def _writer(root: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", root))
        for batch in batches:
            for number, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folder = f"{base}/sub-{number % 100}"
                system.create_dir(folder, recursive=True)
                with system.open_output_stream(f"{folder}/{number}.dcm") as out:  # the same bytes whenever a task runs again
                    out.write(_image(number, name))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    return write


def image_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header file for each customer, written and read back: character sets, byte orders,
    sequences, files without a preamble, and a class taken from the meta group (S4, S5, F5, P1)."""
    root = files.qualified(spark, _shared(spark, None))
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name")
    customers.repartition(8).mapInArrow(_writer(root), "n long").agg(F.sum("n")).collect()
    wanted = {"sop_uid": ("SOPInstanceUID", None), "sop_class_uid": ("SOPClassUID", None), "patient_name": ("PatientName", None), "te": ("EchoTime", headers.D.to_float), "rows": ("Rows", headers.D.to_int), "phantom": ("CTDIPhantomTypeCodeSequence", None)}
    read = headers.read_headers(spark, files.list_files(spark, root, "dcm"), headers.keywords_of(wanted))
    found = headers.projected(read.filter("error is null"), wanted)
    return found.drop("path")


def archive_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of packed archives, written with a manifest and read back from the parts that are
    intact (K15, K17)."""
    digest = F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256")  # packing sees the largest items first: no text goes there
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "doc_id", "n_chars", digest)
    packed = pack_ffd(rows, "source", "doc_id", "n_chars", 50_000)
    members = manifest.archive_members(packed, "source", "doc_id", "n_chars", digest=F.col("sha256"))
    path = f"{_shared(spark, None)}/manifest"
    manifest.write_manifest(members.repartition(8, "source", "chunk"), path, ["source", "chunk", "member"])
    whole = manifest.verified(spark, path).agg(F.min("intact").alias("intact"), F.sum("rows").alias("listed"))
    read = manifest.read_parts(spark, path, "source string, chunk int, member long, bytes long, sha256 string")
    return read.join(F.broadcast(whole))  # one row


QUERIES = {"image_headers": image_headers, "archive_manifest": archive_manifest}
ORACLE_SQL = {
    "archive_manifest": f"""{FFD} SELECT p.source, CAST(chunk - 1 AS INTEGER) AS chunk, name AS member, size AS bytes, sha256(coalesce(text, '')) AS sha256, true AS intact, (SELECT count(*) FROM documents) AS listed FROM p JOIN documents ON doc_id = name""",
    "image_headers": """SELECT '1.2.' || c_custkey AS sop_uid, '1.2.840.10008.5.1.4.1.1.4' AS sop_class_uid, 'Åberg^' || c_name AS patient_name, CAST(c_custkey % 50 AS DOUBLE) + 0.5 AS te, c_custkey % 512 AS rows,
    '[{"00080100": {"vr": "SH", "Value": ["' || (c_custkey % 7) || '"]}}]' AS phantom FROM customer""",
}
