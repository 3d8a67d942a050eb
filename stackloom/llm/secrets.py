"""Secret scans: three base patterns, and sliding-window entropy over candidate strings.

A batch of texts is first searched as bytes: keywords, AKIA, runs of hexadecimal digits and
long runs of token characters with digits or capitals. Only texts with one of these are decoded; there
the patterns run over the whole text. A candidate string is cut into maximal runs of each
character class, a window slides over a run, and its Shannon entropy follows from the two
counts that change with each step. Windows at or above the class's threshold merge into
spans of kind `entropy`, unless ordinary words and numbers between separators, the host of an
address or an allow-list entry explain the window: a path in front of a key does not hide it.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stackloom.llm import shingles as S

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

#: Kinds in the order that breaks ties of start.
KINDS = ("assign", "access", "hex", "entropy")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
WINDOW = 20
#: Character class -> its pattern and the least bits a character of a window that looks random.
CLASSES = (
    ("hex", re.compile(r"[0-9a-fA-F]{20,}"), 2.9),
    ("upper", re.compile(r"[A-Z0-9]{20,}"), 3.4),
    ("base64", re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 3.75),
)
#: What is no secret however it looks: identifiers and placeholders. Only windows that touch one are suppressed.
ALLOWED = (
    r"(?<![0-9a-zA-Z])[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![0-9a-zA-Z])",
    r"(?i)(?:example|dummy|placeholder|changeme|abcdefgh|01234567|xxxx)",
)
#: Ordinary parts of paths and compound names: a word, a number, or a short word with a number.
_ORDINARY = re.compile(r"(?<![A-Za-z0-9])(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[A-Za-z]{1,3}[0-9]{1,4})(?![A-Za-z0-9])")
#: A window counts if so many of its characters belong to no ordinary part.
LEAST_STRANGE = 15
#: A string without digits needs so many capitals, small letters and changes between them.
_CAPITALS, _CHANGES = 4, 5

_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_TOKEN = np.array([chr(b) in "+/_=-" or (b < 128 and chr(b).isalnum()) for b in range(256)])
_HEX = np.array([chr(b) in "0123456789abcdef" for b in range(256)])
_NLOGN = [0.0] + [n * math.log2(n) for n in range(1, WINDOW + 1)]


def windows_entropy(text: str, window: int = WINDOW) -> list[float]:
    """Entropy in bits a character of each window, from counts kept while it slides."""
    counts: dict[str, int] = {}
    terms, out = 0.0, []
    for i, c in enumerate(text):
        n = counts.get(c, 0)
        terms += _NLOGN[n + 1] - _NLOGN[n]
        counts[c] = n + 1
        if i >= window:
            gone = text[i - window]
            n = counts[gone]
            terms += _NLOGN[n - 1] - _NLOGN[n]
            counts[gone] = n - 1
        if i >= window - 1:
            out.append(math.log2(window) - terms / window)
    return out


def _drawn(part: str) -> bool:
    """Whether a window holds the mixture of characters that random strings have."""
    digits, letters = sum(c.isdigit() for c in part), sum(c.isalpha() for c in part)
    if digits:
        return letters >= 3
    upper = [c.isupper() for c in part if c.isalpha()]
    return sum(upper) >= _CAPITALS and len(upper) - sum(upper) >= _CAPITALS and sum(a != b for a, b in zip(upper, upper[1:], strict=False)) >= _CHANGES


def entropy_spans(text: str, allowed: re.Pattern) -> list[tuple[int, int]]:
    """Merged spans of random-looking windows of text that nothing explains."""
    found: list[tuple[int, int]] = []
    for candidate in CANDIDATE.finditer(text):
        a, b = candidate.span()
        explained = [0] * (b - a + 1)  # how many characters before each place are explained
        for m in _ORDINARY.finditer(candidate[0]):
            explained[m.start() + 1 : m.end() + 1] = [1] * (m.end() - m.start())
        if text[max(0, a - 3) : a] == "://":  # the host, or user and host, of an address
            end = candidate[0].find("/") if "/" in candidate[0] else b - a
            explained[1 : end + 1] = [1] * end
        for m in allowed.finditer(candidate[0]):
            explained[m.start() + 1 : m.end() + 1] = [WINDOW] * (m.end() - m.start())
        for i in range(b - a):
            explained[i + 1] += explained[i]
        for _, pattern, least in CLASSES:
            for run in pattern.finditer(text, a, b):
                for i, bits in enumerate(windows_entropy(run[0])):
                    at = run.start() - a + i
                    if bits >= least and explained[at + WINDOW] - explained[at] <= WINDOW - LEAST_STRANGE and _drawn(run[0][i : i + WINDOW]):
                        found.append((run.start() + i, run.start() + i + WINDOW))
    merged: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the three patterns, leftmost and non-overlapping within a kind."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if len(m[0]) >= 16]
    return found


def _long_runs(mask: np.ndarray, least: int, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of at least so many set places; a run ends at every cut."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    inner = np.unique(cuts[(cuts > 0) & (cuts < len(mask))])
    inner = inner[mask[inner] & mask[inner - 1]]
    starts, ends = np.sort(np.concatenate((edges[::2], inner))), np.sort(np.concatenate((edges[1::2], inner)))
    keep = ends - starts >= least
    return starts[keep], ends[keep]


def suspects(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Numbers of the documents that can hold a span of any kind."""
    base = int(offsets[0])
    part, borders = data[base : int(offsets[-1])], offsets - base
    raw = part.tobytes()
    lower = raw.lower()
    places = []
    for needle, where in ((b"AKIA", raw), *((k, lower) for k in KEYWORDS)):
        at = where.find(needle)
        while at >= 0:
            places.append(at)
            at = where.find(needle, at + 1)
    starts, _ = _long_runs(_HEX[part], 16, borders)
    places += starts.tolist()
    digit, capital = (part >= 48) & (part <= 57), (part >= 65) & (part <= 90)
    starts, ends = _long_runs(_TOKEN[part], WINDOW, borders)
    if len(starts):
        digits, capitals = (np.concatenate(([0], np.cumsum(x))) for x in (digit, capital))
        places += starts[(digits[ends] > digits[starts]) | (capitals[ends] - capitals[starts] >= _CAPITALS)].tolist()
    return np.unique(np.searchsorted(borders, np.array(places, np.int64), "right") - 1)


def _scanner(allowed: tuple[str, ...]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile("|".join(f"(?:{x})" for x in allowed).replace("(?i)", "")) if allowed else re.compile(r"(?!)")
        pattern = re.compile(pattern.pattern, re.IGNORECASE)
        rank = {k: i for i, k in enumerate(KINDS)}
        for batch in batches:
            data, offsets = S.texts_of(batch.column(1))
            spans: list[list] = [[] for _ in range(batch.num_rows)]
            for a, b in S.doc_groups(offsets):
                for i in (suspects(data, offsets[a : b + 1]) + a).tolist():
                    text = data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")
                    found = base_spans(text) + [(s, e, "entropy") for s, e in entropy_spans(text, pattern)]
                    spans[i] = [{"kind": k, "start": s, "end": e} for s, e, k in sorted(found, key=lambda x: (x[0], rank[x[2]], x[1]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(_SPAN))], ["id", "spans"])

    return scan


def scan_secrets(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """(id, spans) for every row of documents; spans are structs (kind, start, end) in code
    points, end exclusive, by start and then by kind.

    allowed: regular expressions (any case) for strings whose entropy is not reported; base
    spans are never suppressed. Null and empty texts have no spans. Ids may be null or
    repeated: each row is scanned alone. Extra columns are ignored.
    """
    id_type = documents.schema[id_col].dataType.simpleString()
    return documents.select(id_col, text_col).mapInArrow(_scanner(allowed), f"id {id_type}, spans array<struct<kind:string,start:bigint,end:bigint>>").withColumnRenamed("id", id_col)


def joined_spans(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def base_digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(joined_spans([s for s in spans if s[0] != "entropy"]).encode()).hexdigest()
