"""Language ID by language-bitmask n-gram filters.

Training counts the 4-byte n-grams of labelled texts (letters lower-cased, everything else a
blank) and keeps, for each language, its most frequent ones. They go into one bit-sliced
Bloom filter: a table of 64-bit words with one bit for each language, so that the AND of an
n-gram's few words gives all languages that contain it. A text's score for a language is its
share of n-grams with that bit set, corrected for the filter's false positives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackloom.llm import shingles as S
from stackloom.llm.tables import materialize

UNKNOWN = "und"
SLOTS, HASHES = 1 << 18, 3

_LETTER = np.zeros(256, np.uint8)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = 1
_PLAIN = np.where(_LETTER == 1, S.LOWER, 32).astype(np.uint8)


def held_out(doc_id: Column) -> Column:
    """The documents that training never sees: crc32 of the id's text, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, counts) of each document, those with a letter; blanks surround a text."""
    base, n = int(offsets[0]), len(offsets) - 1
    lengths = np.diff(offsets)
    out = np.full(int(offsets[-1] - base) + 2 * n + 2, 32, np.uint8)
    doc = np.repeat(np.arange(n, dtype=np.int32), lengths)
    out[np.arange(len(doc)) + 2 * doc + 2] = _PLAIN[data[base : int(offsets[-1])]]
    wide = out.astype(np.uint32)
    grams = wide[:-3] | wide[1:-2] << np.uint32(8) | wide[2:-1] << np.uint32(16) | wide[3:] << np.uint32(24)
    keep = grams != np.uint32(0x20202020)
    # A window belongs to the document in which it starts, or to the next one from its blanks on.
    firsts = offsets[:-1] - base + 2 * np.arange(n)
    sums = np.concatenate(([0], np.cumsum(keep)))
    stops = np.concatenate((firsts[1:], [len(grams)]))
    return grams[keep], sums[np.minimum(stops, len(grams))] - sums[np.minimum(firsts, len(grams))]


def _places(grams: np.ndarray) -> Iterator[np.ndarray]:
    mixed = S.mix(grams.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    for i in range(HASHES):
        yield ((mixed >> np.uint64(18 * i)) & np.uint64(SLOTS - 1)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column(0).to_pylist()
        data, offsets = S.texts_of(batch.column(1))
        parts: dict[str, list[np.ndarray]] = {}
        for a, b in S.doc_groups(offsets):
            grams, counts = ngrams(data, offsets[a : b + 1])
            for lang, own in zip(langs[a:b], np.split(grams, np.cumsum(counts)[:-1]), strict=True):
                parts.setdefault(lang, []).append(own)
        for lang, own in parts.items():
            grams, counts = np.unique(np.concatenate(own), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams.astype(np.int64)), pa.array(counts)], ["lang", "gram", "n"])


class Filter:
    """The bit-sliced filter: words[s] has the bits of languages 64 s to 64 s + 63."""

    def __init__(self, langs: list[str], grams: dict[str, np.ndarray]):
        self.langs = langs
        self.words = np.zeros((max(1, -(-len(langs) // 64)), SLOTS), np.uint64)
        for i, lang in enumerate(langs):
            for place in _places(grams[lang].astype(np.uint32)):
                np.bitwise_or.at(self.words[i // 64], place, np.uint64(1 << i % 64))
        filled = [((self.words[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(langs))]
        self.false_rate = np.array(filled) ** HASHES

    def shares(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """(documents, languages): share of n-grams in each language, corrected."""
        out = np.zeros((len(counts), len(self.langs)))
        bounds = np.concatenate(([0], np.cumsum(counts)))
        full = np.flatnonzero(counts > 0)
        if not len(full):
            return out
        places = list(_places(grams))
        for s in range(len(self.words)):
            hit = self.words[s][places[0]]
            for place in places[1:]:
                hit &= self.words[s][place]
            for i in range(64 * s, min(len(self.langs), 64 * s + 64)):
                bit = (hit >> np.uint64(i % 64)).astype(np.uint8) & 1
                hits = np.add.reduceat(bit, bounds[full], dtype=np.int64)
                out[full, i] = np.maximum(0.0, (hits / counts[full] - self.false_rate[i]) / (1 - self.false_rate[i]))
        return out


def train(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", sample_docs: int = 2000, most_grams: int = 8192, mass: float = 0.9, least_ratio: float = 0.25) -> Filter:
    """A filter from labelled rows (null languages are skipped).

    sample_docs bounds the training sample: about so many documents of each language, chosen
    by hash of the id, are read whole; fewer where there are fewer. A language keeps its most
    frequent n-grams up to `mass` of all its occurrences, most_grams at most, without those
    that are rarer in it than least_ratio of their rate in some other language (borrowed
    passages); only these reach the driver.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).filter("lang is not null")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Filter([], {})
    chosen = F.lit(False)
    for lang in langs:
        part = int(min(1.0, sample_docs / sizes[lang]) * (1 << 20))
        chosen = F.when(F.col("lang") == lang, F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < part).otherwise(chosen)
    counted = rows.filter(chosen).select("lang", F.lower("text").alias("text")).mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = materialize(counted, "grams")
    ranked = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = counted.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= most_grams + 1)
    total = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    upto = F.sum("n").over(ranked.rowsBetween(Window.unboundedPreceding, -1))
    top = counted.join(total, "lang").groupBy("gram").agg(F.max(F.col("n") / F.col("total")).alias("top"))
    best = best.withColumn("upto", F.coalesce(upto, F.lit(0))).join(total, "lang").filter((F.col("rank") <= most_grams) & (F.col("upto") < mass * F.col("total")))
    best = best.join(top, "gram").filter(F.col("n") >= least_ratio * F.col("top") * F.col("total"))
    grams: dict[str, list[int]] = {lang: [] for lang in langs}
    for r in best.select("lang", "gram").collect():
        grams[r.lang].append(r.gram)
    return Filter(langs, {k: np.array(v, np.int64) for k, v in grams.items()})


def predict(documents: DataFrame, model: Filter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, coverage) for every row of documents, from its whole text.

    coverage is the winner's corrected share of n-grams, score that share over the sum of all
    languages' shares. `und`, 0 and 0 for texts that are null or have no letter, and for all
    if nothing was learned. A text with letters but no known n-gram gets the first language
    in code-point order with score 0; so do ties. Ids may be null or repeated. Extra columns
    are ignored.
    """
    id_type = documents.schema[id_col].dataType.simpleString()
    shipped = documents.sparkSession.sparkContext.broadcast(model)

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for batch in batches:
            data, offsets = S.texts_of(batch.column(1))
            lettered = batch.column(2).to_numpy(zero_copy_only=False)
            for a, b in S.doc_groups(offsets):
                shares = own.shares(*ngrams(data, offsets[a : b + 1])) if own.langs else np.zeros((b - a, 1))
                best = shares.argmax(axis=1)
                coverage = np.where(lettered[a:b], shares[np.arange(b - a), best], 0.0)
                total = shares.sum(axis=1)
                score = np.where(total > 0, coverage / np.where(total > 0, total, 1), 0.0)
                langs = [own.langs[i] if ok and own.langs else UNKNOWN for i, ok in zip(best, lettered[a:b], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(langs), pa.array(score), pa.array(coverage)], ["id", "lang_pred", "score", "coverage"])

    lettered = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    rows = documents.select(F.col(id_col), F.lower(F.col(text_col)), lettered)
    return rows.mapInArrow(guess, f"id {id_type}, lang_pred string, score double, coverage double").withColumnRenamed("id", id_col)
