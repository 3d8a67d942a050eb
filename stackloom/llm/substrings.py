"""Substring dedup: passages that an earlier document holds already, by FM-indexes of shards.

A window is WINDOW consecutive words. Every window has an anchor, the smallest hash among its
runs of ANCHOR words; equal windows have equal anchors, and neighbouring windows mostly share
one, so a document falls into segments: stretches of words whose windows have one anchor. An
anchor that only one document has cannot lead to a repeat. Segments with other anchors are
dealt to shards by their anchor, so that all windows that could be equal meet, and no shard has
to meet all documents. A shard builds one compressed FM-index of its segments and streams the
same segments through it: backward search gives how far each window matches, and of the windows
that match to their full length the smallest document of the interval.

Anchors that very many segments have are cut into single windows, dealt by all of their words,
and counted once each, before they are shuffled. What comes back are word positions of windows
that an earlier document holds; the documents are read once more and lose these words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackloom.llm import shingles as S
from stackloom.llm.fm_index import FMIndex
from stackloom.llm.tables import BROADCAST_BYTES, broadcast_if_small, materialize

ANCHOR = 5
#: Segments of one anchor beyond which they are cut into windows; words of an index, about.
HOT, SHARD_WORDS = 2_000, 1_000_000
#: Segments that one batch sends on.
BATCH = 16_384
#: Bytes of a word's code in a segment.
CODE = 5
_NO_ID = (1 << 63) - 1


def _minima(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` neighbours, from each place on (shorter at the end)."""
    out, span = values.copy(), 1
    while span < width:
        step = min(span, width - span)
        if len(out) > step:
            np.minimum(out[:-step], out[step:].copy(), out=out[:-step])
        span += step
    return out


def _segments(data: np.ndarray, offsets: np.ndarray, window: int):
    """(words, document, first word within it, windows, first word in words, anchor) of each segment."""
    words, counts = S.word_hashes(data, offsets, lower=False)
    none = np.zeros(0, np.int64)
    run = min(ANCHOR, window)
    if len(words) < window:
        return words, none, none, none, none, none.astype(np.uint64)
    rolled, _ = S.shingle_hashes(words, np.array([len(words)]), run, whole_if_shorter=False)
    smallest = _minima(rolled, window - run + 1)
    per_doc = np.maximum(counts - window + 1, 0)
    doc = np.repeat(np.arange(len(counts)), per_doc)
    own = np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    at = own + np.repeat(np.cumsum(counts) - counts, per_doc)
    anchor = smallest[at]
    first = np.ones(len(doc), bool)
    first[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    heads = np.flatnonzero(first)
    return words, doc[heads], own[heads], np.diff(np.append(heads, len(doc))), at[heads], anchor[heads]


def _rows_of(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    data, offsets = S.texts_of(batch.column("text"))
    for a, b in S.doc_groups(offsets):
        yield a, data, offsets[a : b + 1]


def _anchors(window: int):
    """(anchor, document) of each document's distinct anchors."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for a, data, offsets in _rows_of(batch):
                _, doc, _, _, _, anchor = _segments(data, offsets, window)
                own, counts = S.distinct(anchor, np.bincount(doc, minlength=len(offsets) - 1))
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(np.repeat(ids[a : a + len(counts)], counts))], ["anchor", "id"])

    return anchors


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchors of a batch, and the hot ones among them, as bytes."""
    for batch in batches:
        anchors, hot = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array([anchors.tobytes()]), pa.array([anchors[hot].tobytes()])], ["known", "often"])


def _codes(words: np.ndarray) -> np.ndarray:
    return words.view(np.uint8).reshape(-1, 8)[:, :CODE]


def _content(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The words' codes of each segment, one after another, as bytes."""
    at = np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))
    ends = np.concatenate(([0], np.cumsum(lengths) * CODE)).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(_codes(words)[at]))])


def _window_hash(words: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    rolled = np.zeros(len(starts), np.uint64)
    for i in range(window):
        rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + words[starts + i]
    return S.mix(rolled)


def _emit(window: int, repeated, hot):
    """Segments with a repeated anchor; those of hot anchors as single windows."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = batch.column("key").to_numpy(), batch.column("id").to_numpy()
            lists = batch.column("anchors") if "anchors" in batch.schema.names else None
            for a, data, offsets in _rows_of(batch):
                words, doc, own, windows, start, anchor = _segments(data, offsets, window)
                signed = anchor.view(np.int64)
                if lists is None:
                    known, often = repeated.value, hot.value
                    place = np.minimum(np.searchsorted(known, signed), max(0, len(known) - 1))
                    keep = known[place] == signed if len(known) else np.zeros(len(signed), bool)
                    split = keep & np.isin(signed, often)
                else:
                    keep, split = np.zeros(len(signed), bool), np.zeros(len(signed), bool)
                    bounds = np.searchsorted(doc, np.arange(len(offsets)))
                    for i in range(len(offsets) - 1):
                        part, mine = slice(bounds[i], bounds[i + 1]), lists[a + i]
                        if mine.is_valid:
                            found = mine.values.field("anchor").to_numpy(zero_copy_only=False)
                            often = mine.values.field("hot").to_numpy(zero_copy_only=False)
                            keep[part], split[part] = np.isin(signed[part], found), np.isin(signed[part], found[often])
                # Hot segments become one row a window.
                times = np.where(split, windows, 1)[keep]
                nth = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
                which = np.repeat(np.flatnonzero(keep), times)
                is_hot = split[which]
                first, of_own, n = start[which] + nth, own[which] + nth, np.where(is_hot, 1, windows[which])
                route = signed[which].copy()
                route[is_hot] = _window_hash(words, first[is_hot], window).view(np.int64)
                for at in range(0, len(which), BATCH):
                    p = slice(at, at + BATCH)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(route[p]), pa.array(is_hot[p]), pa.array(keys[a + doc[which[p]]]), pa.array(ids[a + doc[which[p]]]), pa.array(of_own[p], pa.int32()), _content(words, first[p], n[p] + window - 1)],
                        ["route", "hot", "key", "id", "start", "words"],
                    )

    return emit


def _first_documents(window: int):
    """For each distinct segment of a shard, the smallest document that holds each of its windows."""

    def search(segments: pa.Table) -> pa.RecordBatch:
        content = segments["words"].combine_chunks().dictionary_encode()
        which, distinct = content.indices.to_numpy(), content.dictionary
        low, high = np.full(len(distinct), _NO_ID), np.full(len(distinct), np.iinfo(np.int64).min)
        np.minimum.at(low, which, segments["low"].to_numpy())
        np.maximum.at(high, which, segments["high"].to_numpy())
        route = np.empty(len(distinct), np.int64)
        route[which] = segments["route"].to_numpy()
        ends = np.frombuffer(distinct.buffers()[1], np.int32)[distinct.offset : distinct.offset + len(distinct) + 1]
        lengths = np.diff(ends).astype(np.int64) // CODE
        raw = np.frombuffer(distinct.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(-1, CODE)
        words = np.zeros((len(raw), 8), np.uint8)
        words[:, :CODE] = raw
        index = FMIndex(words.view(np.uint64).ravel(), lengths, low, window)
        windows = lengths - window + 1
        owner = np.repeat(np.arange(len(lengths)), windows)
        at = index.starts[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        first = low[owner]
        for begin in range(0, len(at), 1 << 17):
            part = at[begin : begin + (1 << 17)]
            matched, a, b = index.backward(part, window)
            long = np.flatnonzero(matched == window)
            first[begin + long] = index.smallest_owner(a[long], b[long])
        useful = np.zeros(len(lengths), bool)
        useful[owner[first < high[owner]]] = True
        some = np.flatnonzero(useful)
        chosen = useful[owner]
        offsets = np.concatenate(([0], np.cumsum(windows[some]))).astype(np.int32)
        firsts = pa.ListArray.from_arrays(pa.array(offsets), pa.array(first[chosen]))
        return pa.RecordBatch.from_arrays([pa.array(route[some]), distinct.take(pa.array(some)), firsts], ["route", "words", "firsts"])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard = [], None
        for batch in batches:
            numbers = batch.column("shard").to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(numbers[1:] != numbers[:-1]) + 1, [len(numbers)])) if len(numbers) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and numbers[a] != shard:
                    yield search(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(int(a), int(b - a)))
                shard = numbers[a]
        if held:
            yield search(pa.Table.from_batches(held))

    return shards


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _merged(window: int):
    """The spans that windows starting at the given words cover."""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for starts in batch.column("starts"):
                at = np.sort(starts.values.to_numpy(zero_copy_only=False).astype(np.int64))
                cuts = np.flatnonzero(at[1:] > at[:-1] + window)
                first, last = at[np.append(0, cuts + 1)], at[np.append(cuts, len(at) - 1)] + window
                spans.append([{"start": a, "end": b} for a, b in zip(first.tolist(), last.tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(spans, _SPANS)], ["key", "removed"])

    return merged


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, number of words, removed spans, kept words) of each document."""
    for batch in batches:
        n_words, spans, kept = [], [], []
        for text, removed in zip(batch.column("text"), batch.column("removed").to_pylist(), strict=True):
            words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()  # on \x20 and \x09-\x0D
            n_words.append(len(words))
            spans.append(removed or [])
            for span in reversed(spans[-1]):
                del words[span["start"] : span["end"]]
            kept.append(b" ".join(words).decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n_words, pa.int64()), pa.array(spans, _SPANS), pa.array(kept, pa.string())], ["id", "n_words", "removed", "kept"])


def _numbered(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key, id and text of each row: the key is the id where no id is null or repeated, else
    the rows are written once with a number each."""
    rows = documents.select(F.col(id_col).alias("own_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.col(text_col).alias("text"))
    odd = rows.groupBy("id").agg(F.count("*").alias("n")).filter((F.col("n") > 1) | (F.col("id") == _NO_ID))
    if odd.isEmpty():
        return rows.withColumn("key", F.col("id"))
    return materialize(rows.withColumn("key", F.monotonically_increasing_id()), "numbered")


def _repeats(rows: DataFrame, window: int) -> DataFrame:
    """Segments of rows(key, id, text) whose anchor several documents have."""
    spark = rows.sparkSession
    pairs = rows.select("id", "text").mapInArrow(_anchors(window), "anchor long, id long")
    seen = pairs.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n"))
    repeated = materialize(seen.filter("low < high").select("anchor", (F.col("n") > HOT).alias("hot")), "anchors")
    schema = "route long, hot boolean, key long, id long, start int, words binary"
    if 8 * repeated.count() <= BROADCAST_BYTES:
        parts = repeated.mapInArrow(_packed, "known binary, often binary").collect()  # within BROADCAST_BYTES
        known, often = (np.sort(np.frombuffer(b"".join(getattr(p, c) for p in parts), np.int64)) for c in ("known", "often"))
        send = spark.sparkContext.broadcast
        return rows.select("key", "id", "text").mapInArrow(_emit(window, send(known), send(often)), schema)
    own = rows.select("key", "text").withColumnRenamed("key", "id").mapInArrow(_anchors(window), "anchor long, id long")
    lists = own.join(repeated, "anchor").groupBy("id").agg(F.collect_list(F.struct("anchor", "hot")).alias("anchors"))
    asked = rows.select("key", "id", "text").join(lists.withColumnRenamed("id", "key"), "key")
    return asked.mapInArrow(_emit(window, None, None), schema)


def drop_repeats(documents: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, removed, kept) of each row: the words it holds, the spans of words removed
    (start and end, end exclusive, in words), and the words kept, joined by single spaces.

    Words are runs of anything but \\x20 and \\x09-\\x0D, unchanged. A word is removed if a window
    of the row that covers it also starts in a row with a smaller id; windows are judged on the
    input. Null and empty texts have no words. Ids may be null (a null id comes after all
    others) or repeated: rows of one id do not remove each other's words. A window repeated within
    one row stays. Texts shorter than a window lose nothing; an empty table gives no rows. Extra
    columns are ignored. Words are compared as 40-bit hashes of which 13 in a row must agree.
    """
    rows = _numbered(documents, id_col, text_col)
    id_type = documents.schema[id_col].dataType.simpleString()
    occurrences = materialize(_repeats(rows, window), "segments")
    narrow = ["route", F.col("words"), F.col("id").alias("low"), F.col("id").alias("high")]
    often = occurrences.filter("hot").groupBy("route", "words").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    segments = occurrences.filter("not hot").select(*narrow).union(often)
    held = occurrences.agg(F.sum(F.octet_length("words")).alias("bytes")).first().bytes or 0
    spark = documents.sparkSession
    shards = max(1, -(-held // (CODE * SHARD_WORDS)))
    tasks = max(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = segments.withColumn("shard", F.pmod(F.xxhash64("route"), F.lit(tasks))).repartition(tasks, "shard").sortWithinPartitions("shard")
    found = dealt.select("shard", "route", "words", "low", "high").mapInArrow(_first_documents(window), "route long, words binary, firsts array<long>")
    found = materialize(found.select("route", F.xxhash64("words").alias("hash"), "firsts"), "found")
    own = occurrences.select("route", F.xxhash64("words").alias("hash"), "key", "id", "start")
    met = own.join(broadcast_if_small(found, 128), ["route", "hash"])
    earlier = F.filter(F.transform("firsts", lambda first, i: F.when(first < F.col("id"), F.col("start") + i.cast("int"))), lambda x: x.isNotNull())
    starts = met.select("key", earlier.alias("starts")).filter(F.size("starts") > 0).groupBy("key").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    spans = materialize(starts.mapInArrow(_merged(window), "key long, removed array<struct<start:int,end:int>>"), "spans")
    size = spans.agg(F.count("*").alias("n"), F.sum(F.size("removed")).alias("all")).first()
    spans = broadcast_if_small(spans, 1, 64 * size.n + 24 * (size["all"] or 0))
    joined = rows.join(spans, "key", "left").select(F.col("own_id").alias("id"), "text", "removed")
    return joined.mapInArrow(_cleaned, f"id {id_type}, n_words long, removed array<struct<start:int,end:int>>, kept string").withColumnRenamed("id", id_col)
