"""Words and word shingles of whole texts, hashed with numpy on Arrow buffers.

Works on UTF-8 bytes. A text is processed in pieces of PIECE bytes cut between words, so
memory does not follow the longest text (only its word hashes, 8 bytes a word, are held).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 18

#: Bytes that separate words: [\x20\x09-\x0D].
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Every ASCII byte but letters and digits separates.
NON_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Maps A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_RATIO = np.uint64(0x9E3779B97F4A7C15 | 5)
_INVERSE = np.uint64(pow(int(_RATIO), -1, 1 << 64))
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, PIECE + 1)
        up, down = np.full(size, _RATIO), np.full(size, _INVERSE)
        up[0] = down[0] = 1
        have = (np.multiply.accumulate(up), np.multiply.accumulate(down))
        if size <= 4 * PIECE:
            _powers[0] = have
    return have


def texts_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def doc_groups(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about PIECE bytes together, one document at least."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, "right")) - 1)
        yield at, to
        at = to


def _words(data: np.ndarray, starts_at: np.ndarray, separators: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words in data; starts_at: where documents start."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none
    inside = ~separators[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = starts_at[(starts_at > 0) & (starts_at < len(data))]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _power(len(data))
    terms = _BYTE[LOWER[data] if lower else data]
    terms *= up[: len(data)]
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(terms, out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * down[starts]
    return mix(hashes + (ends - starts).astype(np.uint64)), starts, ends


def word_hashes(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = BLANK, lower: bool = True, spans: bool = False):
    """(hashes, counts) of the words of each document; with spans also byte starts and ends,
    relative to data."""
    base, size = int(offsets[0]), int(offsets[-1] - offsets[0])
    if size <= 2 * PIECE:
        hashes, starts, ends = _words(data[base : base + size], offsets[:-1] - base, separators, lower)
    else:  # one long document: pieces cut at a separator
        parts, at = [], 0
        while at < size:
            to = min(size, at + PIECE)
            while to < size:
                ahead = np.flatnonzero(separators[data[base + to : base + min(size, to + 4096)]])
                if len(ahead):
                    to += int(ahead[0])
                    break
                to = min(size, to + 4096)
            h, s, e = _words(data[base + at : base + to], np.clip(offsets[:-1] - base - at, 0, to - at), separators, lower)
            parts.append((h, s + at, e + at))
            at = to
        hashes, starts, ends = (np.concatenate(x) for x in zip(*parts, strict=True))
    bounds = np.searchsorted(starts, offsets - base)
    counts = np.diff(bounds)
    return (hashes, counts, starts + base, ends + base) if spans else (hashes, counts)


def shingle_hashes(words: np.ndarray, counts: np.ndarray, k: int, whole_if_shorter: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the k-word shingles of each document, in order and with repeats.
    A document with 1 to k-1 words has its whole sequence as its one shingle."""
    n = len(words)
    bounds = np.concatenate(([0], np.cumsum(counts)))
    rolled = np.zeros(max(0, n - k + 1), np.uint64)
    for i in range(k):
        rolled *= np.uint64(0xD6E8FEB86659FD93)
        rolled += words[i : n - k + 1 + i] if n >= k else 0
    rolled = mix(rolled ^ np.uint64(k))
    full = np.maximum(counts - k + 1, 0)
    out_counts = np.where((counts > 0) & (counts < k), 1, full) if whole_if_shorter else full
    doc = np.repeat(np.arange(len(counts)), full)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(full) - full, full) + bounds[:-1][doc]
    hashes = rolled[at]
    if whole_if_shorter and (short := np.flatnonzero((counts > 0) & (counts < k))).size:
        own = np.zeros(len(short), np.uint64)
        for i in range(k - 1):
            has = counts[short] > i
            own[has] = own[has] * np.uint64(0xD6E8FEB86659FD93) + words[bounds[short[has]] + i]
        own = mix(own ^ counts[short].astype(np.uint64))
        hashes = np.insert(hashes, (np.cumsum(full) - full)[short], own)
    return hashes, out_counts


def distinct(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each document, and their counts."""
    hashes = hashes.copy()
    bounds = np.concatenate(([0], np.cumsum(counts)))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a > 1:
            hashes[a:b].sort()
    if not len(hashes):
        return hashes, counts.copy()
    keep = np.ones(len(hashes), bool)
    keep[1:] = hashes[1:] != hashes[:-1]
    starts = bounds[:-1][counts > 0]
    keep[starts] = True
    sums = np.concatenate(([0], np.cumsum(keep)))
    return hashes[keep], sums[bounds[1:]] - sums[bounds[:-1]]
