"""Whitening of embeddings by spectral divide and conquer on QDWH polar decompositions.

The covariance of the distinct vectors is summed where they lie; only a dimensions x dimensions
matrix reaches the driver. Its eigenvectors come from polar decompositions: the polar factor of
the covariance less a shift has the eigenvalues +1 and -1, so half of it plus the identity is
the projector on the eigenvectors above the shift. Bases of that subspace and of its complement
split the matrix in two, which are split again until single components are left. The polar
factor is found by the dynamically weighted Halley iteration in its QR form, which needs no
inverse and about six steps. The directions are sent to all tasks, which whiten their rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackloom.llm.centroids import finite, grid
from stackloom.llm.tables import materialize

EPS = np.finfo(float).eps
#: Rows whitened side by side.
BLOCK = 4096


def polar(a: np.ndarray) -> np.ndarray:
    """The unitary polar factor of a symmetric matrix, by QDWH."""
    n = len(a)
    x = a / np.linalg.norm(a)
    try:
        low = 1 / (np.linalg.norm(np.linalg.inv(x), 1) * np.sqrt(n))
    except np.linalg.LinAlgError:
        low = EPS
    low = min(1.0, max(low, EPS))
    for _ in range(40):
        square = low * low
        d = (4 * (1 - square) / square**2) ** (1 / 3)
        root = np.sqrt(1 + d)
        p = root + np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * root)) / 2
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        upper_lower = np.linalg.qr(np.vstack((np.sqrt(r) * x, np.eye(n))))[0]
        step = q / r * x + (p - q / r) / np.sqrt(r) * upper_lower[:n] @ upper_lower[n:].T
        step = (step + step.T) / 2
        low = min(1.0, low * (p + q * square) / (1 + r * square))
        moved, x = np.linalg.norm(step - x), step
        if moved < (4 * EPS) ** (1 / 3) and 1 - low < 10 * EPS or moved < 4 * EPS * n:
            break
    return x


def _halves(h: np.ndarray, scale: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the eigenvectors above and below a shift; None if all eigenvalues are equal."""
    n, mean = len(h), np.trace(h) / len(h)
    if np.linalg.norm(h - mean * np.eye(n)) <= 4 * n * EPS * scale:
        return None
    spread = np.linalg.norm(h - mean * np.eye(n)) / np.sqrt(n)
    # The mean lies between the eigenvalues whenever they differ; a shift that hits one is moved.
    shifts = [float(np.median(np.diag(h))), mean, *(mean + spread * rng.uniform(-0.5, 0.5, 30))]
    for shift in shifts:
        projector = (polar(h - shift * np.eye(n)) + np.eye(n)) / 2
        rank = round(np.trace(projector))
        if not 0 < rank < n or np.linalg.norm(projector @ projector - projector) > 1e-12 * n:
            continue
        above = np.linalg.qr(projector @ rng.standard_normal((n, rank)))[0]
        whole = np.linalg.qr(projector @ above, mode="complete")[0]
        above, below = whole[:, :rank], whole[:, rank:]
        if np.linalg.norm(below.T @ h @ above) <= 64 * n * EPS * scale:
            return above, below
    return None


def eigenvectors(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues from the largest, unit eigenvectors as columns) of a symmetric matrix."""
    rng, scale = np.random.default_rng(5), float(np.linalg.norm(covariance)) or 1.0
    open_, done = [np.eye(len(covariance))], []
    while open_:
        basis = open_.pop()
        if basis.shape[1] > 1:
            own = basis.T @ covariance @ basis
            halves = _halves((own + own.T) / 2, scale, rng)
            if halves is not None:
                open_ += [basis @ half for half in halves]
                continue
        done.append(basis)
    vectors = np.linalg.qr(np.hstack(done))[0]  # what rounding has taken of orthogonality
    values = np.einsum("ij,ij->j", vectors, covariance @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return (n * x - sums) / n  # one rounding of an exact integer


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows and sums of each dimension, a batch at a time."""
    for batch in batches:
        if batch.num_rows:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            dims = np.arange(x.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(dims, pa.int32()), pa.array(np.full(len(dims), len(x))), pa.array(x.sum(axis=0))], ["i", "n", "total"])


def _products(directions: np.ndarray | None, n: int, sums: np.ndarray):
    """A partition's sums of products of centred components (projected, if directions are given)."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                x = batch.column(0).slice(at, BLOCK).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(sums))
                y = _centred(x, n, sums)
                y = y if directions is None else y @ directions
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "total"])

    return products


def _covariance(fit: DataFrame, n: int, sums: np.ndarray, directions: np.ndarray | None = None) -> np.ndarray:
    size = len(sums) if directions is None else directions.shape[1]
    out = np.zeros((size, size))
    for r in fit.mapInArrow(_products(directions, n, sums), "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect():
        out[r.i, r.j] = out[r.j, r.i] = r.total / n
    return out


def _whitened(directions: np.ndarray, n: int, sums: np.ndarray):
    """(id, n, deviation, whitened) of each row."""

    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(sums))
                away = n * x - sums
                if len(away) and float(np.abs(away).max()) ** 2 * len(sums) >= 2.0**63:
                    raise ValueError("deviations beyond what a long holds")
                out = (away / n) @ directions
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * out.shape[1]), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array((away * away).sum(axis=1)), lists], ["id", "deviation", "whitened"])

    return whitened


def whiten(vectors: DataFrame, components: int = 16, scale: int = 64, offset: int = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n, deviation, whitened, explained, identity_error): a row for each vector.

    Components c become x = floor(scale * c) + offset. Mean and covariance are those of the
    distinct x vectors, n of them. whitened holds the centred vector's projections on the leading
    components, each over the square root of its eigenvalue; explained the components' shares of
    the trace; deviation is the sum of (n * x - sum)^2, exact; identity_error the largest entry
    by which the covariance of whitened differs from the identity.

    Vectors that are null or hold null or non-finite entries are dropped, as are empty ones.
    Vectors of each length have a fit of their own. Directions without variance (an eigenvalue
    of rounding size, as of a single distinct vector) are left out. Repeated rows and null ids
    give a row each; an empty table gives none. Extra columns are ignored. The driver holds a
    matrix of dimensions x dimensions, whatever the number of rows; more rows than a long can
    hold deviations of are refused with a ValueError.
    """
    spark = vectors.sparkSession
    id_type = vectors.schema[id_col].dataType.simpleString()
    v = F.col(vector_col)
    x = F.transform(grid(v, scale), lambda c: c + F.lit(offset))
    kept = materialize(vectors.filter((F.size(v) > 0) & finite(v)).select(F.col(id_col).alias("id"), x.alias("x")), "grid")
    schema = f"{id_col} {id_type}, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    out = spark.createDataFrame([], schema)
    for dim in sorted(r[0] for r in kept.select(F.size("x")).distinct().collect()):  # lengths, not rows
        rows = kept.filter(F.size("x") == dim)
        fit = materialize(rows.select("x").distinct(), "distinct")
        found = fit.mapInArrow(_sums, "i int, n long, total long").groupBy("i").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("i").collect()
        n, totals = found[0].n, np.array([r.total for r in found], np.int64)
        covariance = _covariance(fit, n, totals)
        values, basis = eigenvectors(covariance)
        some = np.flatnonzero(values > dim * EPS * max(float(np.trace(covariance)), 0.0) * 16)[:components]
        directions = basis[:, some] / np.sqrt(values[some])
        explained = (values[some] / np.trace(covariance)).tolist() if len(some) else []
        error = float(np.abs(_covariance(fit, n, totals, directions) - np.eye(len(some))).max()) if len(some) else 0.0
        found = rows.mapInArrow(_whitened(directions, n, totals), f"id {id_type}, deviation long, whitened array<double>")
        out = out.union(found.select("id", F.lit(n).cast("long"), "deviation", "whitened", F.array(*map(F.lit, explained)).cast("array<double>"), F.lit(error)))
    return out
