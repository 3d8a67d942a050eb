"""WARC archives: written by Spark's text writer, read by a Python data source.

Writing: a record is a header block, a blank line, the HTTP response and two line ends. The
text writer's line separator is those two line ends, so every part file is a WARC file and
goes to whatever store Spark can reach, with Spark's commit protocol. Pages with equal
payloads are stored once: the smallest page id is the response, the others are revisits that
carry HTTP headers, digest and reference only.

Reading: the format `warc` plans whole files into partitions of about `partition_bytes`
(archives are bounded by the writer's partitions, and a byte range cannot be entered safely
since a payload may hold anything). Filters on record_type, record_id, target_uri, page_id,
payload_digest and refers_to are pushed down and decided on a record's headers; the payload
of any other record, and of all records with payload=false, is skipped by seeking.

Archives of others are read too: record ids may be any URI (page_id is null then), header names
have any case, folded header lines are joined, and records that are no HTTP messages keep all of
their block. A record whose header cannot be read gives a row that says so in `error`, and
reading goes on at the next line that begins a record; so does a record that ends too early.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull

from stackloom.llm.tables import broadcast_if_small, fresh_path, materialize

END = "\r\n\r\n"
#: The moment of capture is no part of the pages table; a fixed one keeps archives equal.
DATE = "1970-01-01T00:00:00Z"
_RECORD = "urn:x-page:"
_KEYS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
SCHEMA = "record_id string, record_type string, target_uri string, date string, page_id long, refers_to long, payload_bytes long, payload_digest string, payload binary, refers_to_id string, error string"
_START = b"WARC/"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _one_line(value: str | None) -> str:
    return "".join(c for c in value or "" if c not in "\r\n")


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for page, url, html, first in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            payload = (html or "").encode("utf-8")
            http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
            revisit = first is not None
            head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_RECORD}{page}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_one_line(url)}"]
            if revisit:
                head += [f"WARC-Refers-To: <{_RECORD}{first}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
            head += [f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (0 if revisit else len(payload))}"]
            out.append("\r\n".join(head) + END + http + ("" if revisit else html or ""))
        for at in range(0, len(out), 256):
            yield pa.RecordBatch.from_arrays([pa.array(out[at : at + 256])], ["value"])


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> None:
    """Write one record for each row of pages below path.

    The payload is the html in UTF-8, null as empty. Of rows with equal payloads of
    least_bytes or more, the one with the smallest id is a response and the others are
    revisits; shorter payloads are all responses. Null urls are empty; line ends in urls are
    dropped. Rows with a null id are not written; rows that repeat an id and a payload give a
    record each, of the same type. An empty table writes no records. Extra columns are ignored.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).filter("id is not null")
    raw = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    digests = materialize(rows.select("id", F.sha1(raw).alias("digest"), F.octet_length(raw).alias("n")).filter(F.col("n") >= least_bytes), "digests")
    firsts = digests.groupBy("digest", "n").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").drop("last")
    revisits = materialize(digests.join(firsts, ["digest", "n"]).filter("id != first").select("id", "first").distinct(), "revisits")
    rows.join(broadcast_if_small(revisits, 24), "id", "left").select("id", "url", "html", "first").mapInArrow(_records, "value string").write.option("lineSep", END).text(path)


#: A header that does not end within this many bytes is no header.
MOST_HEADER = 1 << 20


def _fields(head: bytes) -> dict[str, str] | None:
    """Header fields by lower-case name; lines that begin with a blank go on with the one before."""
    fields, last = {}, None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            fields[last] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            fields[last] = value.strip()
        else:
            return None
    return fields


def _page(record: str | None) -> int | None:
    """The page id in a record id of this writer; null for others."""
    number = (record or "").strip("<>").removeprefix(_RECORD)
    return int(number) if record and re.fullmatch(r"-?\d{1,18}", number) and record.strip("<>").startswith(_RECORD) else None


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.files = json.loads(options["files"])
        self.partition_bytes = int(options.get("partition_bytes", 64 << 20))
        self.payload = options.get("payload", "true").lower() == "true"
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if isinstance(f, EqualTo | In) and column in (*_KEYS, "page_id"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = self.wanted.get(column, values) & values
            elif isinstance(f, IsNotNull) and column in (*_KEYS, "page_id"):
                self.wanted.setdefault(f"{column} is not null", set())
            elif isinstance(f, IsNull) and column == "refers_to":
                self.wanted.setdefault("refers_to is null", set())
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        out, held = [], 0
        for path, size in sorted(self.files):
            if not out or held + size > self.partition_bytes:
                out.append(_Files([]))
                held = 0
            out[-1].paths.append(path)
            held += size
        return out or [_Files([])]

    def _keep(self, row: dict) -> bool:
        for column, values in self.wanted.items():
            if column.endswith(" is not null"):
                if row[column[:-12]] is None:
                    return False
            elif column.endswith(" is null"):
                if row[column[:-8]] is not None:
                    return False
            elif row[column] not in values:
                return False
        return True

    def read(self, partition: _Files) -> Iterator[tuple]:
        from pyarrow import fs

        for path in partition.paths:
            system, inner = fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))
            with system.open_input_file(inner) as raw:
                if inner.endswith(".gz"):  # members in a row; skipping means reading on
                    yield from self._file(gzip.GzipFile(fileobj=raw), float("inf"))
                else:
                    yield from self._file(raw, raw.size())

    def _file(self, raw, end: float) -> Iterator[tuple]:
        at, buffer, start = 0, b"", 0  # buffer holds raw[start:]

        def need(n: int) -> bytes:
            """n bytes at `at`, read ahead in pieces of a megabyte."""
            nonlocal buffer, start
            if at < start or at + n > start + len(buffer):
                raw.seek(at)
                buffer, start = raw.read(max(n, 1 << 20)), at
            return buffer[at - start : at - start + n]

        def lost(why: str) -> tuple:
            return (None,) * 10 + (why,)

        def next_start(after: int) -> float:
            """Where a line begins that begins a record, from `after` on."""
            nonlocal at
            at = after
            while at < end:
                piece = need(int(min(1 << 16, end - at)))
                if (cut := piece.find(b"\n" + _START)) >= 0:
                    return at + cut + 1
                if len(piece) <= len(_START) + 1:
                    break
                at += len(piece) - len(_START)
            return end

        while at < end:
            size = 4096
            while (cut := (head := need(int(min(size, end - at)))).find(b"\r\n\r\n")) < 0 and at + size < end and len(head) >= size and size < MOST_HEADER:
                size *= 2
            if not head.strip():
                break
            if head.startswith(b"\r\n"):  # more blank lines than records have between them
                at += 2
                continue
            fields = _fields(head[:cut]) if cut >= 0 and head.startswith(_START) else None
            if fields is None or not fields.get("content-length", "").isdigit():
                if self._keep(dict.fromkeys((*_KEYS, "page_id"))):
                    yield lost(f"no readable header at byte {at}")
                at = next_start(at + 1)
                continue
            begun = at
            at += cut + 4
            length = int(fields["content-length"])
            row = {c: fields.get(k.lower()) for c, k in _KEYS.items()}
            refers_to_id = row["refers_to"]
            row["page_id"], row["refers_to"] = _page(row["record_id"]), _page(row["refers_to"])
            row["payload_digest"] = (row["payload_digest"] or "").removeprefix("sha1:") or None
            if self._keep(row):
                first = need(min(512, length))
                http_end, stated, error = 0, None, None
                if first.startswith(b"HTTP/"):
                    http_size = 512
                    while (http := need(min(http_size, length))).find(b"\r\n\r\n") < 0 and http_size < length:
                        http_size *= 2
                    found = http.find(b"\r\n\r\n")
                    http_end = found + 4 if found >= 0 else length
                    lines = http[:http_end].decode("latin-1").split("\r\n")
                    stated = next((int(x[15:]) for x in lines if x.lower().startswith("content-length:") and x[15:].strip().isdigit()), None)
                payload, count, digest = None, stated, row["payload_digest"]
                if row["record_type"] != "revisit":
                    count = length - http_end
                    if self.payload:
                        block = need(length)
                        payload = block[http_end:]
                        digest = payload_digest(payload)
                        error = None if len(block) == length else f"the record at byte {begun} ends after {len(block)} of {length} bytes"
                yield (row["record_id"], row["record_type"], row["target_uri"], fields.get("warc-date"), row["page_id"], row["refers_to"], count, digest, payload, refers_to_id, error)
            at += length + 4


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options)


def read_warc(spark: SparkSession, path: str, payload: bool = True, partition_bytes: int = 64 << 20) -> DataFrame:
    """The records of all archives below path, with SCHEMA's columns.

    Files named *.warc, *.warc.gz and Spark's part-* are read. Spark lists them, so any store that
    it reads can be listed; executors open them by URI with pyarrow, which knows local files,
    hdfs, s3 (s3a and s3n are taken as s3) and gs. With payload, payload_digest is computed from a response's bytes, otherwise it is
    the header's. Revisits have no payload; their payload_bytes come from the HTTP headers.
    Bad records give rows with an error, which a filter on headers leaves out. The session's
    setting for filters on Python sources is switched on, for the reader depends on it.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "{part-*,*.warc,*.warc.gz}").load(path).select("path", "length").collect()
    spark.dataSource.register(WarcSource)
    reader = spark.read.format("warc").option("files", json.dumps([[r.path, r.length] for r in listed]))
    return reader.option("payload", str(payload).lower()).option("partition_bytes", str(partition_bytes)).load()


def round_trip(pages: DataFrame, **names) -> DataFrame:
    """Write pages to the shared folder and read the records back, without their payloads'
    bytes but with what was computed from them."""
    path = fresh_path(pages.sparkSession, "warc")
    write_warc(pages, path, **names)
    # Payloads are read of responses only; of revisits the headers are enough.
    responses = read_warc(pages.sparkSession, path).filter("record_type = 'response'")
    revisits = read_warc(pages.sparkSession, path, payload=False).filter("record_type = 'revisit'")
    return responses.union(revisits).drop("payload")
