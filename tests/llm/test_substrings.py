"""Substring dedup and its FM-index against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackloom.llm import substrings
from stackloom.llm.fm_index import FMIndex, WaveletMatrix, WaveletTree
from tests.llm.helpers import awkward_rows, documents, prose


def test_wavelets_count_and_find_the_smallest():
    rng = np.random.default_rng(7)
    for size, kinds in ((1, 1), (200, 3), (3000, 90)):
        seq = np.minimum(rng.zipf(1.5, size) - 1, kinds - 1)
        tree = WaveletTree(seq, kinds + 1)
        symbols, at = rng.integers(0, kinds + 1, 500), rng.integers(0, size + 1, 500)
        assert tree.rank(symbols, at).tolist() == [int((seq[:a] == s).sum()) for s, a in zip(symbols, at, strict=True)]
        low = rng.integers(0, size, 300)
        high = np.minimum(size, low + 1 + rng.integers(0, 50, 300))
        assert WaveletMatrix(seq).smallest(low, high).tolist() == [seq[a:b].min() for a, b in zip(low, high, strict=True)]


@pytest.mark.parametrize("context", [1, 3, 13])
def test_backward_search_finds_every_occurrence(context):
    rng = np.random.default_rng(context)
    lengths = rng.integers(context, context + 9, 80)
    words = rng.integers(0, 3, lengths.sum()).astype(np.uint64) << np.uint64(33)
    owners = rng.integers(0, 30, 80) * 11
    index = FMIndex(words, lengths, owners, context)
    at = np.concatenate([s + np.arange(n - context + 1) for s, n in zip(index.starts, lengths, strict=True)])
    owner_of, held = np.repeat(owners, lengths + 1), defaultdict(list)
    for a in at:
        held[tuple(index.text[a : a + context])].append(owner_of[a])
    matched, low, high = index.backward(at, context)
    for a, m, x, y, first in zip(at, matched, low, high, index.smallest_owner(low, high), strict=True):
        own = held[tuple(index.text[a : a + context])]
        assert (m == context and y - x == len(own) and first == min(own)) or (len(own) == 1 and y - x == 1)


def brute(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, *_ in rows]
    ids = [float("inf") if i is None else i for i, *_ in rows]
    first = {}
    for i, w in zip(ids, words, strict=True):
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for (i, *_), rank, w in zip(rows, ids, words, strict=True):
        gone = {p + o for p in range(len(w) - window + 1) if first[tuple(w[p : p + window])] < rank for o in range(window)}
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out, key=str)


def rows_with_passages(seed):
    rng = random.Random(seed)
    passage, edge = prose(rng, 60), prose(rng, 14)
    rows = awkward_rows(seed)
    for i in range(300, 360):  # a passage that many documents share, with another beginning and end each
        rows.append((i, f"{prose(rng, rng.randrange(20))}\n{passage}\t{prose(rng, rng.randrange(20))}", "en", "a"))
    rows += [(400, edge, "en", "a"), (401, f"x {edge}", "en", "a"), (402, f"{edge} {edge}", "en", "a"), (403, " ".join(["same"] * 50), "en", "a"), (404, " ".join(["same"] * 13), "en", "a")]
    return rows + [(-5, passage, "en", "a"), (405, passage.upper(), "en", "a"), (406, passage + "\x85　tail", "en", "a"), (None, passage, "en", "a"), (300, passage, "en", "a")]


def found_rows(spark, rows, window):
    found = substrings.drop_repeats(documents(spark, rows), window=window)
    size = F.aggregate("removed", F.lit(0), lambda n, s: n + s["end"] - s["start"])
    return sorted(((r.doc_id, r.n_words, r.gone, r.kept) for r in found.select("doc_id", "n_words", size.alias("gone"), "kept").collect()), key=str)


@pytest.mark.parametrize("window", [13, 3])
def test_repeats_are_the_brute_ones(spark, window):
    rows = rows_with_passages(window)
    assert found_rows(spark, rows, window) == brute(rows, window)


def test_hot_anchors_many_shards_and_anchors_too_many_to_send(spark, monkeypatch):
    rows = [r for r in rows_with_passages(5) if r[0] is not None]
    monkeypatch.setattr(substrings, "HOT", 3)
    monkeypatch.setattr(substrings, "SHARD_WORDS", 500)
    assert found_rows(spark, rows, 13) == brute(rows, 13)
    monkeypatch.setattr(substrings, "BROADCAST_BYTES", 0)
    assert found_rows(spark, rows, 13) == brute(rows, 13)


def test_empty_tables(spark):
    assert found_rows(spark, [], 13) == []
    assert found_rows(spark, [(1, None, None, None), (2, "", None, None)], 13) == [(1, 0, 0, ""), (2, 0, 0, "")]
