import random

import numpy as np

from stackloom.llm import shingles as S
from stackloom.llm.components import connected_components
from stackloom.llm.near_dup import near_duplicates, superminhash
from tests.llm.helpers import awkward_rows, brute_components, documents, prose


def sequential_signature(elements, slots):
    """The published algorithm, one element and level after another."""
    values = [2**64 - 1] * slots
    for x in elements.tolist():
        perm = list(range(slots))
        for level in range(slots):
            drawn = int(S.mix(np.array([x], np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))[0])
            k = level + ((drawn & 0xFFFF) * (slots - level) >> 16)
            perm[level], perm[k] = perm[k], perm[level]
            values[perm[level]] = min(values[perm[level]], level << 48 | drawn >> 16)
    return values


def test_signature_equals_the_sequential_algorithm():
    rng = np.random.default_rng(3)
    counts = np.array([1, 2, 0, 40, 300, 7])
    elements = rng.integers(0, 2**63, counts.sum(), dtype=np.uint64)
    got = superminhash(elements, counts, 32)
    ends = np.cumsum(counts)
    for i, (e, c) in enumerate(zip(ends, counts, strict=True)):
        assert got[i].tolist() == sequential_signature(elements[e - c : e], 32)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    a, b = superminhash(np.concatenate((pool[:900], pool[100:])), np.array([900, 900]), 128)
    assert abs((a == b).mean() - 0.8) < 0.15


def test_words_in_pieces_equal_words_at_once(monkeypatch):
    text = (prose(random.Random(2), 3000) + "\n").encode()
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    whole = S.word_hashes(data, offsets)
    monkeypatch.setattr(S, "PIECE", 1000)
    parts = S.word_hashes(data, offsets)
    assert (whole[0] == parts[0]).all() and whole[1].tolist() == parts[1].tolist() == [3000]


def test_components_match_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5), (None, 3)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(8)).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: root(x) for x in parent}


def test_near_duplicates_match_brute_force(spark):
    rows = awkward_rows()
    out = near_duplicates(documents(spark, rows), words=4).collect()
    assert len(out) == len(rows)
    want = brute_components(rows, 4)
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and not r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == want[r.doc_id]
    assert any(not r.kept for r in out)


def test_links_between_members_that_no_centre_has_seen(spark):
    """A chain: each text changes a little more, so only neighbours are linked."""
    rng = random.Random(9)
    words = prose(rng, 200, 5000).split(" ")
    rows = []
    for i in range(30):
        for j in range(4):
            words[(i * 4 + j) * 7 % 200] = f"w{i}x{j}"
        rows.append((i, " ".join(words), "en", "a"))
    rng.shuffle(rows)
    want = brute_components(rows, 4)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(documents(spark, rows), words=4).collect()}
    assert got == want


def test_empty_table(spark):
    assert near_duplicates(documents(spark, [])).collect() == []
