"""Object interface: one call per matrix, with the results hanging off it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .operators.errors import projection_error_wide, score, score_wide, spectral_norm_wide
from .operators.kernels import Spec
from .operators.sketch import merge_pair, single, sketch, state_entries, state_rows
from .operators.spectra import gram_state, leading_vectors, spectrum
from .session import matrix_budget
from .sources import save_sketches


class SketchResult:
    """A sketch of ``matrix`` and what can be asked of it. Everything is lazy until asked for."""

    def __init__(self, matrix: DataFrame, spec: Spec, m: int | None = None, states: DataFrame | None = None, **kwargs):
        self.matrix, self.spec, self.m = matrix, spec, m
        self._states = states if states is not None else sketch(matrix, spec, m=m, **kwargs)

    def state(self) -> DataFrame:
        return self._states

    def entries(self) -> DataFrame:
        return state_entries(self._states).select("i", "j", "v")

    def rows(self) -> DataFrame:
        return state_rows(self._states).select("row_id", "vec")

    def spectrum(self) -> DataFrame:
        return spectrum(self._states).select("k", "sigma", "v")

    @property
    def wide(self) -> bool:
        """Whether an m x m matrix is over the byte budget; errors then come without one."""
        return self.m is not None and 8 * self.m * self.m > matrix_budget()

    def scores(self, k: int | None = None) -> DataFrame:
        """Exact errors; one more pass over the matrix for its Gram matrix, or a few where that is over
        the byte budget. ``sketch_and_score`` gets sketch and errors from a single pass."""
        if self.wide:
            return score_wide(self.matrix, self._states, self.m, k)
        return score(self._states, gram_state(self.matrix, self.m), k)

    def cov_error(self, normalized: bool = True) -> float:
        if self.wide:
            row, data = single(self._states)
            b = data.reshape(-1, self.m)
            worst = spectral_norm_wide(self.matrix, self.m, b)
            return worst / (float(np.vdot(b, b)) + (row["mass_lost"] or 0.0)) if normalized else worst
        row = self.scores().first()
        return row["err"] if normalized else row["abs_err"]

    def projection_error(self, k: int | None = None, normalized: bool = True) -> float:
        if self.wide:
            k = min(max(self.spec.l // 2, 1), 100) if k is None else k
            outside, tail = projection_error_wide(self.matrix, self.m, leading_vectors(self.spectrum(), k), k)
            return outside / tail if normalized else outside
        row = self.scores(k).first()
        return row["proj_err"] if normalized else row["proj_err"] * row["tail"]

    def update(self, more: DataFrame) -> SketchResult:
        """The sketch of this matrix followed by further rows."""
        fresh = sketch(more, self.spec, m=self.m, strict=False)
        both = self.matrix.unionByName(more)
        return SketchResult(both, self.spec, self.m, merge_pair(self._states, fresh, self.spec))

    def save(self, path: str, dataset: str) -> None:
        save_sketches(self._states, path, dataset)


def sketch_matrix(
    matrix: DataFrame, kind: str, l: int, m: int | None = None, buckets: int | None = None,
    randomized: bool = False, randomized_above: int = 100, **params,
) -> SketchResult:
    """Sketch by kind name; ``params`` are those of ``Spec`` (b, alpha, svd, seed, l2, change_at).

    ``kind="auto_pfd"`` takes the form that fits the layout; with ``randomized`` sparse matrices of
    more than ``randomized_above`` l columns are shrunk by the randomized form.
    """
    if kind == "auto_pfd":
        if m is None:
            kind = "batch_pfd"
        else:
            kind = "sparse_rand_batch_pfd" if randomized and m > randomized_above * l else "sparse_batch_pfd"
    return SketchResult(matrix, Spec(kind, l, **params).check(), m, buckets=buckets)

