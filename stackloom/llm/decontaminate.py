"""Benchmark decontamination by SimHash of item-sized windows.

For every benchmark item the windows of a document with exactly the item's number of words
are fingerprinted by SimHash over their word shingles, each weighted by its bytes. Windows
whose shingles occur in no item by the share asked for are left out: they can be similar to
none. A window's fingerprint is a difference of running sums, so that all windows of one size
cost one pass. Fingerprints are looked up in a multi-index: two fingerprints within RADIUS bits
agree to RADIUS // BLOCKS bits in at least one of BLOCKS blocks, so the items that are that near
in some block are all items within the radius and a few more. Those within the radius are
the candidates, and exact weighted-shingle similarity, sum of minima over sum of maxima,
verifies them. Nothing is found but by its fingerprint.

The fingerprints of a window and an item at similarity 0.8 differ in about 20 of 128 bits; the
radius is exceeded with a probability of about 2e-5 (a test measures it), less at a higher
similarity. Items with fewer words than a shingle have none; they are found as exact sequences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackloom.llm import shingles as S

BITS, BLOCKS, RADIUS = 128, 16, 36
#: Items that one pass over the documents carries, and the most bytes of their texts.
ITEMS, ITEM_BYTES = 20_000, 8 << 20
#: Which pairs of block values are near enough.
_VALUES = np.arange(1 << BITS // BLOCKS)
_NEAR = np.bitwise_count(_VALUES[:, None] ^ _VALUES) <= RADIUS // BLOCKS
#: Windows fingerprinted from one piece of running sums.
PIECE = 1 << 12


def _weigh(data: np.ndarray, offsets: np.ndarray, k: int):
    """(shingle hashes, weights, counts, words, starts, ends, word hashes) of each text; a weight is the bytes of
    the shingle's words. A text with fewer than k words has none."""
    hashes, counts, starts, ends = S.word_hashes(data, offsets, S.NON_ALNUM, lower=False, spans=True)
    own, own_counts = S.shingle_hashes(hashes, counts, k, whole_if_shorter=False)
    size = np.concatenate(([0], np.cumsum(ends - starts)))
    first = np.repeat(np.cumsum(counts) - counts, own_counts) + (np.arange(len(own)) - np.repeat(np.cumsum(own_counts) - own_counts, own_counts))
    last = np.minimum(first + k, np.repeat(np.cumsum(counts), own_counts))
    return own, (size[last] - size[first]).astype(np.int64), own_counts, counts, starts, ends, hashes


def _votes(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each shingle its weight for (or against) each bit of a fingerprint."""
    words = [S.mix(hashes + np.uint64(0x9E3779B97F4A7C15 * (i + 1) & (2**64 - 1))) for i in range(BITS // 64)]
    bits = np.unpackbits(np.column_stack(words).view(np.uint8), axis=1).astype(np.int64)
    return (2 * bits - 1) * weights[:, None]


def simhash(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The BITS-bit fingerprint of weighted shingles, as bytes."""
    return np.packbits(_votes(hashes, weights).sum(axis=0) > 0)


def window_simhashes(hashes: np.ndarray, weights: np.ndarray, starts: np.ndarray, span: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(starts, fingerprints) of the windows of `span` shingles at the given ascending starts."""
    at = 0
    while at < len(starts):
        first = int(starts[at])
        to = int(np.searchsorted(starts, first + PIECE))
        part = slice(first, int(starts[to - 1]) + span)
        sums = np.zeros((part.stop - first + 1, BITS), np.int64)
        np.cumsum(_votes(hashes[part], weights[part]), axis=0, out=sums[1:])
        own = starts[at:to] - first
        yield starts[at:to], np.packbits(sums[own + span] - sums[own] > 0, axis=1)
        at = to


def _bag(hashes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A bag of shingles: sorted distinct hashes, and weight times occurrences of each."""
    known, place = np.unique(hashes, return_inverse=True)
    return known, np.bincount(place, weights=weights, minlength=len(known)).astype(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two bags."""
    _, x, y = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][x], b[1][y]).sum())
    return both / max(1, int(a[1].sum()) + int(b[1].sum()) - both)


class Items:
    """Fingerprints, bags and indexes of a bounded set of benchmark items, all in flat arrays."""

    def __init__(self, ids: list[int], texts: list[str], k: int, least: float):
        self.k, self.least = k, least
        own, weights, counts, words, _, _, word_hashes = _weigh(*S.texts_of(pa.array(texts, pa.string())), k)
        long = np.flatnonzero(words >= k)
        self.ids, self.lengths, ends = np.array(ids, np.int64)[long], words[long], np.cumsum(counts)[long]
        parts = [slice(e - c, e) for e, c in zip(ends.tolist(), counts[long].tolist(), strict=True)]
        self.bags = [_bag(own[p], weights[p]) for p in parts]
        self.prints = np.array([simhash(own[p], weights[p]) for p in parts], np.uint8).reshape(-1, BITS // 8)
        self.totals = np.array([int(w.sum()) for _, w in self.bags], np.int64)
        self.shingles = np.unique(np.concatenate([h for h, _ in self.bags])) if len(long) else np.zeros(0, np.uint64)
        self.table = np.zeros(1 << 22, bool)  # quick refusal before the exact search
        self.table[(self.shingles & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        # For each length its items, and for each block and value a bit for each item that is near there.
        self.of_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for length in np.unique(self.lengths).tolist():
            items = np.flatnonzero(self.lengths == length)
            near = np.packbits(_NEAR[self.prints[items]], axis=0, bitorder="little")  # (items / 8, block, value)
            self.of_length[length] = items, np.ascontiguousarray(near.transpose(1, 2, 0))
        # Short items: for each length the hashes of their whole sequences, sorted, and their ids.
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        first = np.cumsum(words) - words
        for n in range(1, k):
            some = np.flatnonzero(words == n)
            if len(some):
                sequences = np.concatenate([word_hashes[a : a + n] for a in first[some].tolist()])
                whole, _ = S.shingle_hashes(sequences, np.full(len(some), n), n, whole_if_shorter=False)
                order = np.argsort(whole, kind="stable")
                self.short[n] = whole[order], np.array(ids, np.int64)[some][order]

    def known(self, hashes: np.ndarray) -> np.ndarray:
        maybe = self.table[(hashes & np.uint64((1 << 22) - 1)).astype(np.int64)]
        at = np.flatnonzero(maybe)
        if len(at):
            place = np.minimum(np.searchsorted(self.shingles, hashes[at]), len(self.shingles) - 1)
            maybe[at] = self.shingles[place] == hashes[at]
        return maybe

    def within(self, length: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs of fingerprints and the items of a length within RADIUS of each
        other: those near in some block, checked whole."""
        items, near = self.of_length[length]
        some = np.bitwise_or.reduce(near[np.arange(BLOCKS), prints], axis=1)
        window, item = np.nonzero(np.unpackbits(some, axis=1, bitorder="little", count=len(items)))
        close = np.bitwise_count(self.prints[items[item]] ^ prints[window]).sum(axis=1) <= RADIUS
        return window[close], items[item[close]]

    def find(self, hashes: np.ndarray, weights: np.ndarray, known: np.ndarray, n_words: int) -> dict[int, tuple[float, int, int]]:
        """item -> (similarity, first word, words) of its best window in one document."""
        found: dict[int, tuple[float, int, int]] = {}
        whole, shared = (np.concatenate(([0], np.cumsum(w))) for w in (weights, weights * known))
        for length, (items, _) in self.of_length.items():
            need = self.least * self.totals[items].min()
            if shared[-1] < need:
                continue
            span = max(1, min(length, n_words) - self.k + 1)
            inside = shared[span:] - shared[:-span]
            starts = np.flatnonzero((inside >= need) & (inside >= self.least * (whole[span:] - whole[:-span])))
            for at, prints in window_simhashes(hashes, weights, starts, span):
                window, item = self.within(length, prints)
                last, bag = -1, None
                for w, j in zip(window.tolist(), item.tolist(), strict=True):
                    if w != last:
                        place = int(at[w])
                        last, bag = w, _bag(hashes[place : place + span], weights[place : place + span])
                    name, score = int(self.ids[j]), similarity(bag, self.bags[j])
                    if score >= self.least and score > found.get(name, (0.0,))[0]:
                        found[name] = (score, place, min(length, n_words))
        return found

    def find_short(self, word_hashes: np.ndarray, words: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, first word in it, words) where a short item first stands in a document."""
        for n, (whole, ids) in self.short.items():
            own, counts = S.shingle_hashes(word_hashes, words, n, whole_if_shorter=False)
            low, high = np.searchsorted(whole, own), np.searchsorted(whole, own, "right")
            hits = np.flatnonzero(high > low)
            doc = np.searchsorted(np.cumsum(counts), hits, "right")
            at = hits - (np.cumsum(counts) - counts)[doc]
            seen = set()
            for h, d, a in zip(hits.tolist(), doc.tolist(), at.tolist(), strict=True):
                for item in ids[low[h] : high[h]].tolist():
                    if (d, item) not in seen:
                        seen.add((d, item))
                        yield d, item, a, n


def _finder(shipped):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shipped.value
        for batch in batches:
            ids = batch.column(0)
            data, offsets = S.texts_of(batch.column(1))
            out: list[tuple] = []
            for a, b in S.doc_groups(offsets):
                own, weights, counts, words, starts, ends, word_hashes = _weigh(data, offsets[a : b + 1], items.k)
                known = items.known(own)
                upto = np.concatenate(([0], np.cumsum(known)))
                stops, word_starts = np.cumsum(counts), np.cumsum(words) - words
                found = [(i, item, 1.0, at, n) for i, item, at, n in items.find_short(word_hashes, words)]
                for i in np.flatnonzero(upto[stops] - upto[stops - counts] > 0).tolist():
                    part = slice(stops[i] - counts[i], stops[i])
                    found += [(i, item, *best) for item, best in items.find(own[part], weights[part], known[part], int(words[i])).items()]
                for i, item, score, at, length in found:
                    first, last = word_starts[i] + at, word_starts[i] + at + length - 1
                    before = data[offsets[a + i] : starts[first]].tobytes().decode("utf-8", "replace")
                    inside = data[starts[first] : ends[last]].tobytes().decode("utf-8", "replace")
                    out.append((a + i, item, score, len(before), len(before) + len(inside)))
            at, item, score, start, end = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), pa.array(item, pa.int64()), pa.array(score, pa.float64()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["id", "item_id", "similarity", "start", "end"])

    return find


def find_leaks(
    documents: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    words: int = 5,
    least: float = 0.8,
) -> DataFrame:
    """(id, item_id, similarity, start, end): for each document and item whose best window
    reaches `least`, that window in code points of the lower-cased text.

    Words are runs of letters, digits and non-ASCII characters, lower-cased. The benchmark is
    counted and carried in passes of ITEMS items and ITEM_BYTES bytes at most, so its size is
    free. Documents without a leak give no row. Null and empty texts, and items with a null
    id or no words, match nothing; an item with fewer than `words` words is found where a
    document holds exactly its words in a row. Ids may be null or repeated: each row of the
    documents is searched alone, and repeated items give a row each for items of one id only
    once. Extra columns are ignored.
    """
    spark = documents.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.lower(F.coalesce(item_text_col, F.lit(""))).alias("text")).filter("id is not null and text != ''")
    held = items.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    passes = max(1, -(-held.n // ITEMS), -(-(held.bytes or 0) // ITEM_BYTES))
    id_type = documents.schema[id_col].dataType.simpleString()
    rows = documents.select(F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("text"))
    schema = f"id {id_type}, item_id long, similarity double, start long, end long"
    found = spark.createDataFrame([], schema)
    for i in range(passes):
        part = items.filter(F.pmod(F.xxhash64("id"), F.lit(passes)) == i).orderBy("id", "text").collect()
        if part:
            shipped = spark.sparkContext.broadcast(Items([r.id for r in part], [r.text for r in part], words, least))
            found = found.union(rows.mapInArrow(_finder(shipped), schema))
    return found.withColumnRenamed("id", id_col)
