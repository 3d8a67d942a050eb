"""MinHash near-duplicates by SuperMinHash.

Every document gets its set of word shingles. Equal sets collapse into one class first, so
copies cost one row each. Class representatives get a SuperMinHash signature: each element
draws one slot per level from a permutation that all its levels share, the value of a slot
is level + random part, and a document stops as soon as every slot is taken. Bands of the
signature make buckets; buckets propose pairs; pairs are confirmed on the full shingle sets
of the whole texts; confirmed links are grouped by union-find.

Pairs come in two rounds, never all at once. The first compares every member of a bucket with
one centre, the member that meets most others over all its buckets. A bucket whose members
then share one component is finished. The documents of the others are joined by an exact
prefix filter: a document's shingles are ordered by how few of these documents have them, and
a pair is compared only if a shingle at the start of both leaves enough room behind it for
the similarity asked for. So no link inside a bucket is lost, and copies with many changes,
which have their own shingles in front, meet next to nothing.

Comparing blocks of centres with all later members instead made 560,000 pairs on the larger
check table, where these two rounds make 74,000.

With 32 bands of 4 slots a pair at similarity 0.8 shares no bucket with probability 5e-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackloom.llm import shingles as S
from stackloom.llm.components import connected_components
from stackloom.llm.tables import broadcast_if_small, materialize

_EMPTY = np.uint64(2**64 - 1)
_GOLDEN = 0x9E3779B97F4A7C15


def superminhash(elements: np.ndarray, counts: np.ndarray, slots: int) -> np.ndarray:
    """(documents, slots) signatures of distinct 64-bit elements, documents one after another.

    The level is in the upper 16 bits of a value, 48 random bits below. Documents without
    elements keep the empty value.
    """
    n = len(counts)
    values = np.full(n * slots, _EMPTY)
    doc = np.repeat(np.arange(n), counts)
    x, perm = elements, None
    for level in range(slots):
        drawn = S.mix(x + np.uint64((level + 1) * _GOLDEN & (2**64 - 1)))
        pick = level + ((drawn & np.uint64(0xFFFF)) * np.uint64(slots - level) >> np.uint64(16)).astype(np.int64)
        value = (drawn >> np.uint64(16)) | np.uint64(level << 48)
        if level == 0:
            slot, first = pick, pick
        else:
            if perm is None:  # the first swap, now that it matters
                perm = np.broadcast_to(np.arange(slots, dtype=np.uint16), (len(x), slots)).copy()
                rows = np.arange(len(x))
                perm[rows, first], perm[rows, 0] = 0, first
            rows = np.arange(len(x))
            slot = perm[rows, pick].astype(np.int64)
            perm[rows, pick], perm[rows, level] = perm[rows, level], slot
        np.minimum.at(values, doc * slots + slot, value)
        open_docs = (values.reshape(n, slots) == _EMPTY).any(axis=1)
        keep = open_docs[doc]
        if not keep.any():
            break
        if not keep.all():
            doc, x = doc[keep], x[keep]
            if perm is not None:
                perm = perm[keep]
            elif level == 0:
                first = first[keep]
    return values.reshape(n, slots)


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """(documents, bands) bucket keys; the band's number is part of its key."""
    n, slots = signatures.shape
    parts = signatures[:, : slots // rows * rows].reshape(n, slots // rows, rows)
    keys = np.broadcast_to(np.arange(slots // rows, dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(rows):
        keys = S.mix(keys * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, i])
    return keys


#: Pairs of one document that are confirmed together.
PART = 1024


def _signer(words: int, bands: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = S.texts_of(batch.column(1))
            for a, b in S.doc_groups(offsets):
                hashes, counts = S.distinct(*S.shingle_hashes(*S.word_hashes(data, offsets[a : b + 1]), words))
                keys = band_keys(superminhash(hashes, counts, bands * rows), rows).view(np.int64)
                ends = np.cumsum(counts)
                digests = [xxhash.xxh3_128_intdigest(hashes[e - c : e].tobytes()) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                high = np.array([d >> 64 for d in digests], np.uint64).view(np.int64)
                low = np.array([d & (2**64 - 1) for d in digests], np.uint64).view(np.int64)
                offs = pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(counts.astype(np.int64)), pa.array(high), pa.array(low), pa.ListArray.from_arrays(offs, pa.array(keys.ravel()))],
                    ["id", "n", "d1", "d2", "bands"],
                )

    return sign


def _confirmer(words: int, percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_id, last_set = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                data, offsets = S.texts_of(part.column(3))
                linked = np.zeros(part.num_rows, bool)
                ids = part.column(0).to_pylist()
                for i, a in enumerate(ids):
                    if a != last_id:
                        own, _ = S.texts_of(part.column(2).slice(i, 1)), None
                        last_id, last_set = a, S.distinct(*S.shingle_hashes(*S.word_hashes(own[0], own[1]), words))[0]
                    other = S.distinct(*S.shingle_hashes(*S.word_hashes(data, offsets[i : i + 2]), words))[0]
                    at_least = np.searchsorted(last_set, other)
                    at_least[at_least == len(last_set)] = 0
                    both = int((last_set[at_least] == other).sum()) if len(last_set) else 0
                    linked[i] = both > 0 and 100 * both >= percent * (len(last_set) + len(other) - both)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(linked)], ["a", "b", "linked"])

    return confirm


def _confirmed(texts: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked, checked on whole texts. A document with many pairs meets
    them in parts of about PART, each with a copy of its text."""
    parts = materialize(pairs.groupBy("a").agg(F.ceil(F.count("*") / PART).alias("parts")), "parts")
    dealt = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), "parts")).drop("parts")
    own = texts.toDF("a", "text_a").join(parts, "a").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    joined = dealt.join(texts.toDF("b", "text_b"), "b").join(own, ["a", "part"])
    checked = joined.select("a", "b", "text_a", "text_b").sortWithinPartitions("a").mapInArrow(_confirmer(words, percent), "a long, b long, linked boolean")
    return materialize(checked.filter("linked").select("a", "b"), "links")


def _shingler(words: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = S.texts_of(batch.column(2))
            for a, b in S.doc_groups(offsets):
                hashes, counts = S.distinct(*S.shingle_hashes(*S.word_hashes(data, offsets[a : b + 1]), words))
                take = np.repeat(np.arange(a, b), counts)
                own = [pa.array(batch.column(i).to_numpy()[take]) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.repeat(counts, counts)), pa.array(hashes.view(np.int64))], ["id", "label", "n", "shingle"])

    return cut


def _prefix_pairs(labelled_texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) of different labels that can reach the similarity, from (id, label, text)."""
    rows = materialize(labelled_texts.mapInArrow(_shingler(words), "id long, label long, n long, shingle long"), "shingles")
    # Written, so that the join's exchange is its own and a frequent shingle's rows can be split.
    known = materialize(rows.groupBy("shingle").agg(F.count("*").alias("df")), "frequencies")
    place = F.row_number().over(Window.partitionBy("id").orderBy("df", "shingle")) - 1
    prefix = rows.join(known, "shingle").withColumn("place", place).filter((F.col("df") > 1) & (F.col("place") * 100 <= F.col("n") * (100 - percent)))
    prefix = materialize(prefix.drop("df"), "prefixes")
    # Within a shingle's list one side leaves out the label that most of the list has.
    most = prefix.groupBy("shingle", "label").agg(F.count("*").alias("x")).groupBy("shingle").agg(F.max_by("label", F.struct("x", "label")).alias("usual"), F.count("*").alias("labels")).filter("labels > 1")
    most = materialize(most, "usual-labels")
    mixed = prefix.join(most, "shingle").drop("labels")
    left = mixed.filter("label != usual").select("shingle", F.col("id").alias("a"), F.col("label").alias("own"), F.col("n").alias("an"), F.col("place").alias("at"))
    room = F.least(F.col("n") - F.col("place"), F.col("an") - F.col("at"))
    reaches = room * (100 + percent) >= (F.col("n") + F.col("an")) * percent
    once = (F.col("label") == F.col("usual")) | (F.col("a") < F.col("id"))
    pairs = left.join(mixed, "shingle").filter((F.col("own") != F.col("label")) & once & reaches)
    return materialize(pairs.select("a", F.col("id").alias("b")).distinct(), "pairs")


def near_duplicates(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    percent: int = 80,
    bands: int = 32,
    rows: int = 4,
) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of documents.

    Words are runs without [\\x20\\x09-\\x0D], A-Z lower-cased; a set holds the distinct
    `words`-word shingles, or the whole sequence of a shorter text. Two documents are linked
    if 100 * intersection >= percent * union. component_id is the smallest id reachable over
    links, kept says that it is the document's own.

    Null and empty texts have no shingles, are linked with nothing and are kept. Rows with a
    null id have a null component_id and are not kept. Repeated rows (one id, one text) get
    the same result each; an id must not stand for different texts. Extra columns are ignored.
    """
    named = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = named.mapInArrow(_signer(words, bands, rows), "id long, n long, d1 long, d2 long, bands array<long>")
    signed = materialize(signed, "signatures")
    usable = signed.filter("n > 0 and id is not null")
    classes = materialize(usable.groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.max("n").alias("n"), F.count("*").alias("copies"), F.min_by("bands", "id").alias("bands")), "classes")

    posted = classes.select("rep", "n", F.explode("bands").alias("band"))
    # Written, like the centres and mixed buckets, so that AQE can split a frequent band's rows.
    met = materialize(posted.groupBy("band").agg(F.count("*").alias("members")).filter("members > 1"), "buckets")
    members = materialize(posted.join(met, "band"), "bucket-members")
    # The documents of all buckets, their texts, and how many others each meets.
    crowd = materialize(members.groupBy("rep").agg(F.sum("members").alias("meets"), F.first("n").alias("n")), "candidates")
    texts = named.join(broadcast_if_small(crowd.select(F.col("rep").alias("id")), 16), "id", "left_semi")
    texts = materialize(texts, "candidate-texts")

    ranked = members.join(crowd.drop("n"), "rep")
    centres = ranked.groupBy("band").agg(F.max(F.struct("meets", (-F.col("rep")).alias("minus"), F.col("n").alias("centre_n"))).alias("c"))
    centres = materialize(centres.select("band", (-F.col("c.minus")).alias("centre"), "c.centre_n"), "centres")
    stars = members.join(centres, "band").filter("rep != centre")
    stars = stars.filter((F.col("n") * 100 >= F.col("centre_n") * percent) & (F.col("centre_n") * 100 >= F.col("n") * percent))
    stars = materialize(stars.select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    links = _confirmed(texts, stars, words, percent)
    labels = materialize(connected_components(links), "labels")

    # Buckets of three and more members can hold links that their centre has no part in.
    labelled = members.filter("members > 2").select("band", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    labelled = materialize(labelled, "labelled")
    mixed = materialize(labelled.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x != y"), "mixed")
    rest = labelled.join(mixed, "band", "left_semi").groupBy("rep").agg(F.first("label").alias("label"))
    pairs = _prefix_pairs(texts.join(rest.withColumnRenamed("rep", "id"), "id").select("id", "label", "text").dropDuplicates(["id"]), words, percent)
    more = _confirmed(texts, pairs, words, percent)
    if not more.isEmpty():
        labels = materialize(connected_components(links.union(more)), "labels")

    found = classes.select("d1", "d2", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    found = found.select("d1", "d2", F.coalesce("label", "rep").alias("component"))
    # A class of one document without links keeps its own id: only the others are joined.
    grouped = found.join(classes.select("d1", "d2", "copies", F.col("rep").alias("own")), ["d1", "d2"]).filter("copies > 1 or component != own").select("d1", "d2", "component")
    out = signed.drop("bands").join(grouped, ["d1", "d2"], "left")
    component = F.when(F.col("id").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("id")).otherwise(F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
