"""Gram matrices, singular values and vectors, projections."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import gaussian_hash
from ..layouts import dense_block, entries_to_sparse_rows, list_array
from ..session import check_bytes, map_arrow, small_rows
from .algebra import matmul_small
from .kernels import Spec, orthonormal
from .sketch import _state_rows, single, sketch, state_entries

MAX_DIRECTIONS = 20_000
SPECTRUM = "key string, grid_id int, k int, sigma double, v array<double>"


def gram_state(matrix: DataFrame, m: int | None = None, key: str | None = None) -> DataFrame:
    """A'A as a state row: one narrow pass, one m x m sum per task."""
    return sketch(matrix, Spec("gram"), key=key, m=m)


def gram(matrix: DataFrame, m: int | None = None) -> DataFrame:
    return state_entries(gram_state(matrix, m)).select("i", "j", "v")


def gram_of_entries(entries: DataFrame, m: int) -> DataFrame:
    """A'A of a sparse matrix. Rows are packed (at most m entries each) and multiplied inside the
    tasks, so pairs of entries are never shuffled; zero cells are left out."""
    return gram(entries_to_sparse_rows(entries), m).filter(F.col("v") != 0)


def canonical(vectors: np.ndarray) -> np.ndarray:
    """Rows with the sign that makes their largest component positive."""
    top = np.abs(vectors).argmax(axis=1)
    signs = np.sign(vectors[np.arange(len(vectors)), top])
    return vectors * np.where(signs == 0, 1.0, signs)[:, None]


def _spectrum_batch(row, sigma, vectors) -> pa.RecordBatch:
    n = len(sigma)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([row["key"]] * n, pa.string()),
            pa.array([row["grid_id"]] * n, pa.int32()),
            pa.array(np.arange(n), pa.int32()),
            pa.array(sigma, pa.float64()),
            list_array(canonical(vectors)),
        ],
        ["key", "grid_id", "k", "sigma", "v"],
    )


def spectrum(states: DataFrame) -> DataFrame:
    """Singular values (descending) and right singular vectors of what each state stands for: of A
    for a Gram state or a triangular factor, of the sketch otherwise."""

    def decompose(batches):
        for row in _state_rows(batches):
            data, m = row["data"], row["m"]
            if row["kind"] == "gram":
                values, vectors = np.linalg.eigh(data.reshape(m, m))
                sigma, vectors = np.sqrt(np.maximum(values[::-1], 0.0)), vectors[:, ::-1].T
            elif row["kind"] == "qr":
                sigma, vectors = _from_triangle(data.reshape(-1, m))
            elif row["kind"] == "range":
                sigma, vectors = _from_range(data.reshape(row["l"], row["l"] + m))
            else:
                _, sigma, vectors = np.linalg.svd(data.reshape(-1, m), full_matrices=False)
            yield _spectrum_batch(row, sigma, vectors)

    return map_arrow(states, decompose, SPECTRUM)


def _from_range(total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum of Q'A from Y'Y and Y'A, where Q is an orthonormal basis of the columns of Y."""
    width = len(total)
    values, w = np.linalg.eigh(total[:, :width])
    good = values > values[-1] * 1e-13
    projected = (w[:, good] / np.sqrt(values[good])).T @ total[:, width:]
    _, sigma, vectors = np.linalg.svd(projected, full_matrices=False)
    return sigma, vectors


def _from_triangle(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum of A from its factor R. Values are taken as lengths |R v|: a rounded v has next to nothing
    of larger directions, so small values keep their digits where the columns of A differ in scale."""
    if not len(r):
        return np.zeros(0), r
    _, _, vectors = np.linalg.svd(r, full_matrices=False)
    sigma = np.linalg.norm(r @ vectors.T, axis=0)
    order = np.argsort(-sigma, kind="stable")
    return sigma[order], vectors[order]


def thin_svd(matrix: DataFrame, m: int | None = None, method: str = "gram") -> DataFrame:
    """(k, sigma, v) of a matrix whose width allows m x m states, from one pass.

    ``method="gram"`` sums A'A, which squares the condition: sigma below about 1e-8 of the largest is
    lost. ``method="qr"`` merges triangular factors of the rows (tall-skinny QR), at several times the
    work, and keeps them; of fewer than m rows it gives as many values as there are rows.
    """
    if method not in ("gram", "qr"):
        raise ValueError(f"unknown method {method!r}")
    return spectrum(sketch(matrix, Spec(method), m=m, strict=False)).select("k", "sigma", "v")


def left_vectors(rows: DataFrame, svd: DataFrame, tol: float = 1e-7) -> DataFrame:
    """Rows of U = A V / sigma, for the directions with sigma above ``tol`` of the largest."""
    sigma, v = small_svd(svd)
    good = sigma > tol * sigma[0]
    return matmul_small(rows, v[good].T / sigma[good])


def randomized_svd(
    matrix: DataFrame, k: int, m: int, oversample: int = 8, power: int = 2, seed: int = 0
) -> DataFrame:
    """Leading k singular values and right vectors by a seeded range finder, uncentred.

    Each power step and the closing product is one narrow pass. The blocks of all steps span the
    range (block Krylov), which resolves flat spectra better than the last block alone for the same
    number of passes; what returns to the driver is m x (k + oversample) numbers per step.
    """
    width = min(k + oversample, m)
    check_bytes(8 * m * width * (power + 1), "the range finder blocks")
    x = orthonormal(gaussian_hash(np.arange(m)[:, None], np.arange(width)[None, :], seed))
    blocks = [x]
    for _ in range(power):
        _, data = single(sketch(matrix, Spec("product", width), m=m, aux={0: x}, strict=False))
        x = orthonormal(data.reshape(width, m).T)
        blocks.append(x)
    span = orthonormal(np.hstack(blocks)[:, :m])
    state = sketch(matrix, Spec("range", span.shape[1]), m=m, aux={0: span}, strict=False)
    return spectrum(state).filter(F.col("k") < k).select("k", "sigma", "v")


def small_svd(svd: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """sigma and the rows v of a spectrum table, on the driver (it is at most m x m)."""
    size = svd.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("m")).first()
    if not size.n:
        raise ValueError("empty spectrum")
    check_bytes(8 * size.n * size.m, "the singular vectors")
    table = svd.select("k", "sigma", "v").toArrow().sort_by("k")
    v = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(size.n, size.m)
    return table["sigma"].to_numpy(), v


def top_directions(svd: DataFrame, k: int) -> DataFrame:
    return svd.orderBy(F.desc("sigma")).limit(k)


def tail_energy(svd: DataFrame, k: int) -> DataFrame:
    """Sum of sigma squared beyond the first k."""
    beyond = F.when(F.col("k") >= k, F.col("sigma") * F.col("sigma")).otherwise(0.0)
    return svd.agg(F.coalesce(F.sum(beyond), F.lit(0.0)).alias("tail"))


def low_rank_sketch(states: DataFrame, k: int) -> DataFrame:
    """Best rank-k part of each sketch, as its first k triplets."""
    return spectrum(states).filter(F.col("k") < k)


def leading_vectors(svd: DataFrame, k: int, tol: float = 1e-7) -> np.ndarray:
    """The first k right vectors, without those of vanishing sigma (a Gram matrix resolves sigma to
    about 1e-8 of the largest)."""
    sigma, v = small_svd(svd.filter(F.col("k") < k))
    return v[sigma > tol * sigma[0]]


def projection_matrix(svd: DataFrame, k: int) -> np.ndarray:
    """Orthogonal projector on the span of the first k right vectors; never inverts A A'."""
    v = leading_vectors(svd, k)
    check_bytes(8 * v.shape[1] ** 2, "the projector")
    return v.T @ v


def project_rows(rows: DataFrame, vectors: np.ndarray, reduced: bool = False) -> DataFrame:
    """A V' V, or the coordinates A V' when ``reduced``; ``vectors`` holds orthonormal rows."""
    if reduced:
        return matmul_small(rows, vectors.T)

    def project(batches):
        for batch in batches:
            if batch.num_rows:
                inside = (dense_block(batch.column("vec")) @ vectors.T) @ vectors
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row_id"), list_array(inside)], ["row_id", "vec"]
                )

    return map_arrow(rows.select("row_id", "vec"), project, "row_id bigint, vec array<double>")
