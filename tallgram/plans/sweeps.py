"""Parameter sweeps: a grid of sketches of one matrix, scored against the exact Gram matrix.

All grid points share a single pass over the data (each task keeps one accumulator per point); a sparse
matrix too wide for its Gram matrix takes a few more, shared as well. ``time_s`` is filled only where a
point is run by itself.
"""

from __future__ import annotations

import time
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.clustering import kmeans_on_sketch
from ..operators.errors import SCORES, score, sketch_and_score
from ..operators.kernels import Spec
from ..operators.ranges import balanced_sparse_starts
from ..operators.sketch import STATE, sketch
from ..sources.store import RESULTS


def run_grid(
    matrix: DataFrame,
    points: list[dict],
    exp: str,
    dataset: str,
    k: int | None = None,
    key: str | None = None,
    m: int | None = None,
    per_pass: int = 32,
) -> DataFrame:
    """Results rows for ``points``: dicts with ``spec``, ``variant``, ``param_name``,
    ``param_value`` and optionally ``run``. ``per_pass`` bounds the accumulators a task holds; a
    larger grid takes several passes."""
    out = None
    for start in range(0, len(points), per_pass):
        chunk = dict(enumerate(points[start : start + per_pass], start))
        specs = [replace(p["spec"], grid_id=n).check() for n, p in chunk.items()]
        scored = sketch_and_score(matrix, specs, key=key, m=m, k=k)
        part = _results(scored.join(_grid(matrix, chunk), "grid_id"), exp, dataset)
        out = part if out is None else out.unionByName(part)
    return out


def _grid(matrix: DataFrame, points: dict[int, dict]) -> DataFrame:
    """Labels of the grid points, one row each."""
    labels = [
        (n, p["variant"], p["param_name"], float(p["param_value"]), p.get("run", 0))
        for n, p in points.items()
    ]
    schema = "grid_id int, variant string, param_name string, param_value double, run int"
    return F.broadcast(matrix.sparkSession.createDataFrame(labels, schema))


def _results(scored: DataFrame, exp: str, dataset: str, partitions=None, time_s=None) -> DataFrame:
    first, second = F.col("delta_first"), F.col("delta") - F.col("delta_first")
    columns = {
        "exp": F.lit(exp),
        "dataset": F.lit(dataset),
        "partitions": F.lit(partitions),
        "time_s": F.lit(time_s),
        "l_bound": F.when(first > 0, first / (first + second)),
    }
    out = scored
    for name, value in columns.items():
        if name not in out.columns:
            out = out.withColumn(name, value)
    fields = [f.split() for f in RESULTS.split(", ")]
    extra = [c for c in ("grid_id", "delta", "mass_lost", "abs_err", "sketch_mass", "sq_norm", "certified") if c in out.columns]
    return out.select(*[F.col(n).cast(t).alias(n) for n, t in fields], *extra)


def sweep_sketch_compare(
    matrix: DataFrame, sizes: list[int], m: int, b: int = 40, alpha: float = 0.2, dataset: str = "matrix"
) -> DataFrame:
    """Every sketch kind at every size, all from one scan for as many points as ``run_grid`` takes at once."""
    kinds = {
        "jlt": lambda l: Spec("jlt", l),
        "cw": lambda l: Spec("cw", l),
        "fd": lambda l: Spec("fd", l),
        "pfd": lambda l: Spec("pfd", l, alpha=alpha),
        "batch-pfd": lambda l: Spec("batch_pfd", l, b=b, alpha=alpha),
        "rand-batch-pfd": lambda l: Spec("rand_batch_pfd", l, b=b, alpha=alpha),
    }
    points = [
        dict(spec=make(l), variant=name, param_name="l", param_value=l)
        for name, make in kinds.items()
        for l in sizes
    ]
    return run_grid(matrix, points, "sketch", dataset, m=m)


def sweep_alpha(matrix, l: int, alphas: list[float], dataset: str = "matrix", k=None) -> DataFrame:
    return run_grid(
        matrix,
        [
            dict(spec=Spec("pfd", l, alpha=a), variant="pfd", param_name="alpha", param_value=a)
            for a in alphas
        ],
        "alpha",
        dataset,
        k,
    )


def sweep_batch_size(
    matrix, l: int, sizes: list[int], runs: int = 1, randomized: bool = False, dataset: str = "matrix", k=None
) -> DataFrame:
    svd = "randomized" if randomized else "gram"
    points = [
        dict(
            spec=Spec("batch_fd", l, b=b, svd=svd, seed=run), variant="batch-fd", param_name="b",
            param_value=b, run=run,
        )
        for b in sizes
        for run in range(runs)
    ]
    return run_grid(matrix, points, "batch", dataset, k)


def sweep_rand_vs_exact(
    matrix, l: int, alpha: float, sizes: list[int], runs: int = 3, dataset: str = "matrix", k=None
) -> DataFrame:
    points = []
    for b in sizes:
        for run in range(runs):
            for variant, kind in (("exact", "batch_pfd"), ("randomized", "rand_batch_pfd")):
                spec = Spec(kind, l, b=b, alpha=alpha, seed=run)
                points.append(
                    dict(spec=spec, variant=variant, param_name="b", param_value=b, run=run)
                )
    return run_grid(matrix, points, "rand_batch", dataset, k)


def sweep_tweak_vs_batch(
    matrix, l: int, alphas: list[float], fast: bool = True, double: bool = False, dataset: str = "matrix"
) -> DataFrame:
    """l-row buffer against batch variant. With ``double`` the former runs at 2l and only its first
    l rows are scored."""
    kind = "tweak_fast" if fast else "tweak_slow"
    tweak_l = 2 * l if double else l
    points = []
    for a in alphas:
        points.append(
            dict(spec=Spec(kind, tweak_l, alpha=a), variant="tweak", param_name="alpha", param_value=a)
        )
        points.append(
            dict(spec=Spec("batch_pfd", l, b=l, alpha=a), variant="batch", param_name="alpha", param_value=a)
        )
    if not double:
        return run_grid(matrix, points, "tweak", dataset, max(l // 2, 1))
    specs = [replace(p["spec"], grid_id=n) for n, p in enumerate(points)]
    states = sketch(matrix, [*specs, Spec("gram", grid_id=len(specs))])
    cut = states.filter("kind <> 'gram'").select(*truncated_state(l))
    scored = score(cut, states, max(l // 2, 1), len(specs))
    return _results(scored.join(_grid(matrix, dict(enumerate(points))), "grid_id"), "tweak", dataset)


def truncated_state(l: int) -> list:
    """Columns of a state cut to its first l rows; what is cut counts as lost mass, and the largest
    cut row (rows are in descending order) as subtracted."""
    keep = F.expr(f"slice(data, 1, {l} * m)")
    cut = F.expr(f"slice(data, {l} * m + 1, greatest((filled - {l}) * m, 0))")
    first = F.expr(f"slice(data, {l} * m + 1, if(filled > {l}, m, 0))")

    def squares(x):
        return F.aggregate(x, F.lit(0.0), lambda t, v: t + v * v)

    changed = {
        "data": keep,
        "filled": F.least("filled", F.lit(l)),
        "l": F.least("l", F.lit(l)),
        "delta": F.col("delta") + squares(first),
        "mass_lost": F.col("mass_lost") + squares(cut),
    }
    return [changed.get(n, F.col(n)).alias(n) for n in (f.split()[0] for f in STATE.split(", "))]


def sweep_changepoint(
    matrix, l1: int, l2: int, b: int, points: list[int], dataset: str = "matrix", k=None
) -> DataFrame:
    """Dynamic sketch at each change point, with fixed-size baselines; ``l_bound`` is the realised
    size."""
    grid = [
        dict(
            spec=Spec("dynamic_fd", l1, b=b, l2=l2, change_at=t), variant="dynamic",
            param_name="t", param_value=t,
        )
        for t in points
    ]
    grid.append(dict(spec=Spec("batch_fd", l1, b=b), variant="l1", param_name="t", param_value=0))
    grid.append(dict(spec=Spec("batch_fd", l2, b=b), variant="l2", param_name="t", param_value=0))
    out = run_grid(matrix, grid, "dynamic", dataset, k)
    share = F.coalesce("l_bound", F.lit(0.0))
    size = (
        F.when(F.col("variant") == "l1", F.lit(float(l1)))
        .when(F.col("variant") == "l2", F.lit(float(l2)))
        .otherwise(l1 * share + l2 * (1 - share))
    )
    return out.withColumn("l_bound", size)


def timed(matrix: DataFrame, point: dict, exp: str, dataset: str, m: int | None = None, partitions: int | None = None, **kwargs) -> DataFrame:
    """Results row of one point run as a job of its own, with the seconds it took."""
    started = time.perf_counter()
    rows = sketch_and_score(matrix, point["spec"], m=m, **kwargs).collect()
    took = time.perf_counter() - started
    scored = matrix.sparkSession.createDataFrame(rows, SCORES).select(
        "*", F.lit(point["variant"]).alias("variant"), F.lit(point["param_name"]).alias("param_name"),
        F.lit(float(point["param_value"])).alias("param_value"), F.lit(point.get("run", 0)).alias("run"),
    )
    return _results(scored, exp, dataset, partitions, took)


def sweep_rand_scale(matrix, sizes: list[int], b: int, dataset: str = "matrix") -> DataFrame:
    """Runtime of the randomized sketch by size; every point is a timed job."""
    out = None
    for l in sizes:
        point = dict(spec=Spec("rand_batch_pfd", l, b=b), variant="randomized", param_name="l", param_value=l)
        part = timed(matrix, point, "rand_scale", dataset)
        out = part if out is None else out.unionByName(part)
    return out


def sweep_partitions(
    matrix, l: int, alpha: float, b: int, parts: list[int], m: int | None = None, runs: int = 1, dataset: str = "matrix"
) -> DataFrame:
    """Exact and randomized sketches with the rows split into each number of parts; every point is a
    timed job. Sparse rows (with ``m``) use the sparse kinds and are split into ranges of ids with
    equally many entries."""
    sparse = "idx" in matrix.columns
    kinds = {
        "exact": "sparse_batch_pfd" if sparse else "batch_pfd",
        "randomized": "sparse_rand_batch_pfd" if sparse else "rand_batch_pfd",
    }
    out = None
    for p in parts:
        for variant, kind in kinds.items():
            for run in range(runs):
                spec = Spec(kind, l, b=b, alpha=alpha, seed=run)
                point = dict(spec=spec, variant=variant, param_name="partitions", param_value=p, run=run)
                split = dict(starts=balanced_sparse_starts(matrix, p)) if sparse else dict(buckets=p)
                part = timed(matrix, point, "parallel", dataset, m, p, **split)
                out = part if out is None else out.unionByName(part)
    return out


def sweep_clusters(rows: DataFrame, ks: list[int], sizes: list[int], seed: int = 0) -> DataFrame:
    """k, l, sketch_cost, full_cost over the grid."""
    out = None
    for l in sizes:
        part = kmeans_on_sketch(rows, l, ks, seed)
        out = part if out is None else out.unionByName(part)
    return out
