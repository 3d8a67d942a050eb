"""Whitening and centroid clustering against plain numpy versions."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackloom.llm import queries
from stackloom.llm.centroids import SortedLists, centroid_digest, cluster_vectors
from stackloom.llm.whitening import eigenvectors, polar, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, id string, x long, cluster string, n int"


def table_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, "a", 2, "b", 3) for i, v in rows], SCHEMA)


def awkward(dim, n=150, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, dim) * (1 + np.arange(dim) % 5)]) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(40)]  # a hot vector
    rows += [(700, None), (701, []), (702, [None] * dim), (703, [float("nan")] * dim), (704, [float("inf")] + [0.0] * (dim - 1)), (None, rows[3][1]), rows[5], rows[5]]
    return rows + [(705, [0.0] * dim), (706, [1.0] * (dim - 1))]


def finite_rows(rows, dim):
    return [(i, np.array(v, float)) for i, v in rows if v and len(v) == dim and None not in v and np.isfinite(v).all()]


def test_polar_and_eigenvectors():
    rng = np.random.default_rng(2)
    for values in (rng.normal(size=12), np.array([3.0, 3, 3, 1, 1, 0.5]), np.array([1.0, 1e-3, 1e-9, 0, 0]), np.full(4, 2.0), np.array([5.0]), np.concatenate((np.geomspace(1, 1e-5, 40), np.zeros(3)))):
        basis = np.linalg.qr(rng.normal(size=(len(values), len(values))))[0]
        a = basis @ np.diag(values) @ basis.T
        a = (a + a.T) / 2
        found, vectors = eigenvectors(a)
        assert np.allclose(found, np.sort(values)[::-1], atol=1e-13 * np.linalg.norm(values))
        assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-13)
        assert np.linalg.norm(a @ vectors - vectors * found) < 1e-13 * len(values) * np.linalg.norm(values)
    a = rng.normal(size=(9, 9))
    a += a.T
    u = polar(a)
    assert np.allclose(u @ u, np.eye(9), atol=1e-13) and np.allclose(u @ a, (u @ a).T, atol=1e-12)
    assert (np.linalg.eigvalsh(u @ a) > 0).all()


def brute_whitening(rows, dim, components):
    x = np.floor(64 * np.array([v for _, v in rows])).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = (n * fit - s) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    away = n * x - s
    return n, (away**2).sum(axis=1), (away / n) @ vectors[:, :components] / np.sqrt(values[:components]), values[:components] / values.sum()


def test_whitening_is_numpys_up_to_sign(spark):
    rows = awkward(24)
    found = whiten(table_of(spark, rows)).filter(F.size("whitened") > 0).collect()
    kept = finite_rows(rows, 24)
    n, deviation, expected, explained = brute_whitening(kept, 24, 16)
    by_key = lambda i, d: (i is None, i, d)
    assert len(found) == len(kept)
    got = sorted(found, key=lambda r: by_key(r.vec_id, r.deviation))
    order = sorted(range(len(kept)), key=lambda j: by_key(kept[j][0], deviation[j]))
    assert [(r.vec_id, r.n, r.deviation) for r in got] == [(kept[j][0], n, deviation[j]) for j in order]
    mine = np.array([r.whitened for r in got])
    sign = np.sign((mine * expected[order]).sum(axis=0))
    assert np.allclose(mine * sign, expected[order], atol=1e-9)
    assert np.allclose(got[0].explained, explained, rtol=1e-9) and got[0].identity_error < 1e-9


def test_whitening_of_nothing_and_of_one_vector(spark):
    assert whiten(table_of(spark, [])).count() == 0
    assert whiten(table_of(spark, [(1, None), (2, []), (3, [float("nan")])])).count() == 0
    one = whiten(table_of(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect()
    assert [(r.n, r.deviation, r.whitened, r.identity_error) for r in one] == [(1, 0, [], 0.0)] * 2
    flat = whiten(table_of(spark, [(i, [float(i), 2.0 * i, 7.0]) for i in range(5)])).collect()
    assert all(len(r.whitened) == 1 for r in flat) and abs(flat[0].explained[0] - 1) < 1e-12


def test_whitening_on_the_table(spark, sf_dir="/root/testdata/sf0.001"):
    rows = queries.op12_whitening(spark, sf_dir).toPandas()
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    n, deviation, expected, explained = brute_whitening([(r.vec_id, np.array(r.embedding, float)) for r in table], 64, 16)
    assert len(rows) == 16 * len(table) and set(rows["n"]) == {n} and rows["identity_error"].max() < 1e-9
    wide = rows.pivot(index="vec_id", columns="component", values="whitened").loc[[r.vec_id for r in table]].to_numpy()
    assert np.allclose(np.abs((wide * expected).mean(axis=0)), (expected**2).mean(axis=0), rtol=1e-8)
    assert np.allclose(rows.drop_duplicates("component").sort_values("component")["explained"], explained, rtol=1e-9)


def brute_clusters(rows, k, rounds, dim):
    kept = [(i, np.floor(64 * v).astype(np.int64)) for i, v in finite_rows(rows, dim)]
    seeds = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), x.tolist()) for i, x in kept if i is not None)[:k]
    centroids = [np.array(x) for _, x in seeds]
    nearest = lambda x: min((int(((x - c) ** 2).sum()), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        which = [nearest(x)[1] for _, x in kept]
        for j in set(which):
            own = [x for (_, x), w in zip(kept, which, strict=True) if w == j]
            centroids[j] = np.array([int(t) // len(own) for t in np.sum(own, axis=0)])
    return [(i, nearest(x)) for i, x in kept], centroids


@pytest.mark.parametrize("k", [1, 5, 400])
def test_clusters_are_the_brute_ones(spark, k):
    rows = awkward(8)
    expected, centroids = brute_clusters(rows, k, 3, 8)
    found = cluster_vectors(table_of(spark, rows), k=k, dim=8).collect()
    key = lambda r: (r[0] is None, r[0], r[1])
    assert sorted(((r.vec_id, (r.distance, r.cluster)) for r in found), key=key) == sorted(expected, key=key)
    for r in found[:20]:
        assert r.centroid == centroids[r.cluster].tolist()
        assert r.cluster_inertia == sum(d for _, (d, c) in expected if c == r.cluster) and r.inertia == sum(d for _, (d, _) in expected)


def test_clusters_of_nothing_and_large_components(spark):
    assert cluster_vectors(table_of(spark, [(1, None), (2, [1.0])]), dim=8).count() == 0
    with pytest.raises(ValueError):
        cluster_vectors(table_of(spark, [(1, [3e6] * 8)]), dim=8)


def test_walks_end_early_and_stay_exact():
    rng = np.random.default_rng(4)
    centroids = rng.integers(-1000, 1000, (300, 2))
    vectors = rng.integers(-1000, 1000, (2000, 2))
    which, best, measured = SortedLists(centroids).nearest(vectors)
    distances = ((vectors[:, None] - centroids) ** 2).sum(axis=2)
    assert (which == distances.argmin(axis=1)).all() and (best == distances.min(axis=1)).all()
    assert measured < 0.5 * distances.size  # most centroids are never measured
    ties = SortedLists(np.array([[2, 0], [0, 0], [2, 0], [0, 0]])).nearest(np.array([[1, 0], [0, 0], [2, 0]]))
    assert ties[0].tolist() == [0, 1, 0]
    assert centroid_digest([1, -2]) == hashlib.sha256(b"1,-2").hexdigest()
