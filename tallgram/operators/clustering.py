"""k-means on tall matrices: training, assignment, costs, centres."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import required, sq_distance
from ..layouts import dense_block, list_array
from ..session import check_bytes, expected_partitions, lookup, map_arrow, matrix_budget, stored
from .kernels import Spec
from .sketch import FAN_IN, sketch
from .spectra import leading_vectors, project_rows, spectrum

CENTERS = "label int, center array<double>"
#: Rows that starting centres are drawn from, draws of which the best is taken, and steps each is moved.
SAMPLE, RESTARTS, LOCAL_STEPS = 20_000, 2, 8
#: Lloyd steps end when no centre moves farther.
TOLERANCE = 1e-4


def centers_array(centers: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Labels and centres on the driver (k x m numbers, their bytes checked before they are fetched), in
    label order."""
    size = centers.agg(F.sum(F.size("center").cast("long") * 8 + 16).alias("bytes")).first()["bytes"] or 0
    check_bytes(size, "the centres")
    table = centers.select(F.col("label").cast("int").alias("label"), F.col("center").cast("array<double>").alias("center")).toArrow().sort_by("label")
    return table.column("label").to_numpy().astype(np.int32), dense_block(table.column("center").combine_chunks())


def _nearest(block: np.ndarray, centers: np.ndarray, cells: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Position of the closest centre (lowest on ties) and squared distance, for so many rows at a
    time that their distances to all centres take at most ``cells`` numbers."""
    step = max(1, cells // max(len(centers), 1))
    if len(block) <= step:
        return _nearest_of(block, centers)
    parts = [_nearest_of(block[i : i + step], centers) for i in range(0, len(block), step)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _nearest_of(block: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for all rows at once.

    Distances come from one matrix product; rows where two centres are nearly level are decided by
    direct differences.
    """
    norms = np.einsum("ij,ij->i", block, block)
    rough = norms[:, None] - 2.0 * (block @ centers.T) + np.einsum("ij,ij->i", centers, centers)
    choice = rough.argmin(axis=1)
    best = rough[np.arange(len(block)), choice]
    slack = 1e-9 * (norms + np.abs(best) + 1.0)
    for row in np.flatnonzero((rough <= (best + slack)[:, None]).sum(axis=1) > 1):
        choice[row] = ((centers - block[row]) ** 2).sum(axis=1).argmin()
    return choice, ((block - centers[choice]) ** 2).sum(axis=1)


def nearest_centroid(rows: DataFrame, centers: DataFrame, keep_vec: bool = False) -> DataFrame:
    """row_id, label, sq_dist (and vec): a narrow pass, the centres travel with the tasks."""
    labels, points = centers_array(centers)
    schema = "row_id bigint, label int, sq_dist double" + (", vec array<double>" if keep_vec else "")
    names = ["row_id", "label", "sq_dist"] + (["vec"] if keep_vec else [])

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                block = dense_block(batch.column("vec"))
                choice, dist = _nearest(block, points)
                columns = [batch.column("row_id"), pa.array(labels[choice]), pa.array(dist)]
                yield pa.RecordBatch.from_arrays(
                    columns + ([list_array(block)] if keep_vec else []), names
                )

    return map_arrow(rows.select("row_id", "vec"), assign, schema)


def label_join(labelled: DataFrame, centers: DataFrame) -> DataFrame:
    """Each labelled row with the centre of its label; the rows are not shuffled while the centres
    are few enough to broadcast. A label without a centre raises."""
    missing = F.raise_error(F.concat(F.lit("no centre for label "), F.coalesce(F.col("label").cast("string"), F.lit("NULL"))))
    center = F.when(F.col("center").isNull(), missing.cast("array<double>")).otherwise(F.col("center"))
    return labelled.join(lookup(centers, "centers"), "label", "left").select(
        "row_id", "label", "vec", center.alias("center")
    )


def kmeans_cost(labelled: DataFrame, centers: DataFrame) -> DataFrame:
    """Sum of squared distances to the centre of the given label."""
    distance = sq_distance(F.col("vec"), F.col("center"))
    terms = label_join(labelled, centers).select(required(distance).alias("d"))
    return terms.agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("cost"))


def kmeans_cost_nearest(rows: DataFrame, centers: DataFrame) -> DataFrame:
    return nearest_centroid(rows, centers).agg(
        F.coalesce(F.sum("sq_dist"), F.lit(0.0)).alias("cost")
    )


def compute_centers(labelled: DataFrame) -> DataFrame:
    """Mean vector per label; averages are combined on the map side, so label sizes do not matter."""
    means = (
        labelled.select("label", F.posexplode(required(F.col("vec"))).alias("j", "v"))
        .groupBy("label", "j")
        .agg(F.avg(required(F.col("v"))).alias("v"))
    )
    packed = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("jv"))
    return packed.select("label", F.col("jv.v").alias("center"))


def distinct_labels(labelled: DataFrame) -> DataFrame:
    return labelled.agg(F.countDistinct("label").alias("k"))


def cost_from_labels(labelled: DataFrame) -> DataFrame:
    """Cost of given labels with the centres they imply, in one pass over the rows.

    Per label and column the sum of squares around the mean is sum(v^2) - n mean^2; a variance
    aggregate computes it without cancellation.
    """
    spread = (
        labelled.select("label", F.posexplode(required(F.col("vec"))).alias("j", "v"))
        .groupBy("label", "j")
        .agg((F.var_pop(required(F.col("v"))) * F.count("v")).alias("ss"))
    )
    return spread.agg(
        F.coalesce(F.sum("ss"), F.lit(0.0)).alias("cost"), F.countDistinct("label").alias("k")
    )


def grid_sums(rows: DataFrame, grid: dict[int, np.ndarray], onto: np.ndarray | None = None) -> dict[int, np.ndarray]:
    """For several sets of k centres at once, from one scan: k x (m + 3) arrays with the sum of the rows
    closest to each centre, their number, their squared norms and their squared distances.

    With ``onto`` (orthonormal rows) the closest centre is found on the coordinates A V', and sums are
    those of A. Tasks hand over one array for each set, which are added up ``FAN_IN`` at a time.
    """
    width = next(iter(grid.values())).shape[1] if onto is None else onto.shape[1]
    check_bytes(sum(8 * len(p) * (width + 3) for p in grid.values()), "the sums of a grid of centres")

    def gather(batches):
        totals = {g: np.zeros((len(p), width + 3)) for g, p in grid.items()}
        for batch in batches:
            if not batch.num_rows:
                continue
            block = dense_block(batch.column("vec"))
            coordinates = block if onto is None else block @ onto.T
            squares = np.einsum("ij,ij->i", block, block)
            for g, points in grid.items():
                choice, distance = _nearest(coordinates, points)
                order = np.argsort(choice, kind="stable")
                used, heads = np.unique(choice[order], return_index=True)
                rest = np.column_stack([np.ones(len(block)), squares, distance])[order]
                totals[g][used, :width] += np.add.reduceat(block[order], heads, axis=0)
                totals[g][used, width:] += np.add.reduceat(rest, heads, axis=0)
        yield from rows_of(totals, TaskContext.get().partitionId())

    def rows_of(totals, part):
        for g, total in totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([g], pa.int32()), pa.array([part], pa.int32()), list_array(total.reshape(1, -1))], ["g", "part", "total"]
            )

    def add_up(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for g, part, total in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                total = total.values.to_numpy(zero_copy_only=False)
                sums[g, part] = sums[g, part] + total if (g, part) in sums else total
        for (g, part), total in sums.items():
            yield from rows_of({g: total}, part)

    schema = "g int, part int, total array<double>"
    parts = map_arrow(rows.select("row_id", "vec"), gather, schema)
    rounds = max(1, math.ceil(math.log(max(expected_partitions(rows), 2), FAN_IN)))
    for number in range(rounds):
        group = F.lit(0) if number == rounds - 1 else F.floor(F.col("part") / FAN_IN).cast("int")
        parts = map_arrow(parts.withColumn("part", group).repartition("g", "part"), add_up, schema)
    out = {g: np.zeros((len(p), width + 3)) for g, p in grid.items()}
    found = parts.toArrow()
    for g, total in zip(found.column("g").to_pylist(), found.column("total")):
        out[g] = total.values.to_numpy().reshape(out[g].shape)
    return out


def lloyd_grid(rows: DataFrame, grid: dict[int, np.ndarray], steps: int, tol: float = 0.0) -> dict[int, np.ndarray]:
    """At most ``steps`` Lloyd iterations of several sets of centres; each step is one scan for all sets
    whose centres still move by more than ``tol``. A centre without rows stays put."""
    active, out = dict(grid), dict(grid)
    for _ in range(steps):
        if not active:
            break
        for g, total in grid_sums(rows, active).items():
            width, points = active[g].shape[1], active[g]
            count = total[:, width : width + 1]
            out[g] = np.where(count > 0, total[:, :width] / np.maximum(count, 1.0), points)
            active[g] = out[g]
            if ((out[g] - points) ** 2).sum(axis=1).max(initial=0.0) <= tol * tol:
                del active[g]
    return out


def centers_frame(rows: DataFrame, points: np.ndarray, labels=None) -> DataFrame:
    labels = range(len(points)) if labels is None else labels
    table = pa.table({"label": pa.array(labels, pa.int32()), "center": list_array(points)})
    return rows.sparkSession.createDataFrame(table, CENTERS)


def lloyd(rows: DataFrame, centers: DataFrame, steps: int) -> DataFrame:
    """At most ``steps`` Lloyd iterations from given centres, fewer when they stop moving; a centre
    without rows stays put. Each step is one pass."""
    labels, points = centers_array(centers)
    rows = stored(rows.select("row_id", "vec"), "lloyd") if steps > 1 else rows
    return centers_frame(rows, lloyd_grid(rows, {0: points}, steps)[0], labels)


def seeds(rows: DataFrame, ks: list[int], seed: int = 0, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """Starting centres for each k: the better of ``RESTARTS`` k-means++ draws, moved a few steps, on at
    most ``sample`` rows (those with the smallest seeded hash). Fewer than k where there are fewer
    different rows."""
    width = rows.select(F.size("vec").alias("m")).first()
    if width is None:
        raise ValueError("no rows to cluster")
    sample = max(1, min(sample, matrix_budget() // (16 * max(width.m, 1))))
    place = F.xxhash64(F.lit(seed), "row_id", "vec")
    found = rows.select("vec", place.alias("place")).orderBy("place").limit(sample).select("vec").toArrow()
    block = dense_block(found.column("vec").combine_chunks())
    rng = np.random.default_rng(seed)
    out = {}
    for k in ks:
        tries = []
        for _ in range(RESTARTS):
            points = spread(block, k, rng)
            for _ in range(LOCAL_STEPS):
                choice, distance = _nearest(block, points)
                order = np.argsort(choice, kind="stable")
                used, heads = np.unique(choice[order], return_index=True)
                sums = np.add.reduceat(block[order], heads, axis=0)
                points = points.copy()
                points[used] = sums / np.diff(np.append(heads, len(block)))[:, None]
            tries.append((float(_nearest(block, points)[1].sum()), points))
        out[k] = min(tries, key=lambda t: t[0])[1]
    return out


def spread(block: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k rows drawn one after the other in proportion to the squared distance from those before."""
    picked = [int(rng.integers(len(block)))]
    distance = ((block - block[picked[0]]) ** 2).sum(axis=1)
    while len(picked) < k and distance.sum() > 0:
        picked.append(int(rng.choice(len(block), p=distance / distance.sum())))
        distance = np.minimum(distance, ((block - block[picked[-1]]) ** 2).sum(axis=1))
    return block[picked]


def kmeans_train(rows: DataFrame, k: int, seed: int = 0, steps: int = 20, starts: DataFrame | None = None):
    """(cost, centres, labelled rows): Lloyd steps from ``seeds`` or from given centres, one scan each."""
    kept = stored(rows.select("row_id", "vec"), "kmeans")
    points = seeds(kept, [k], seed)[k] if starts is None else centers_array(starts)[1]
    labels = None if starts is None else centers_array(starts)[0]
    points = lloyd_grid(kept, {0: points}, steps, TOLERANCE)[0]
    cost = float(grid_sums(kept, {0: points})[0][:, -1].sum())
    centers = centers_frame(rows, points, labels)
    return cost, centers, nearest_centroid(kept, centers, keep_vec=True)


def reduction(rows: DataFrame, l: int, alpha: float = 0.2) -> np.ndarray:
    """Orthonormal rows spanning the first l directions of a sketch of the matrix.

    The sketch has m columns however many rows there are, where a sketch of the transpose would be
    as wide as the data is tall.
    """
    state = sketch(rows, Spec("rand_batch_pfd", l, b=l, alpha=alpha))
    return leading_vectors(spectrum(state), l)


def label_by_reduced(rows: DataFrame, v: np.ndarray, centers: DataFrame) -> DataFrame:
    """row_id, label, vec: the centre closest to each row's coordinates on ``v``. One narrow pass
    over the original rows, so labels need not be joined back."""
    labels, points = centers_array(centers)

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                block = dense_block(batch.column("vec"))
                choice, _ = _nearest(block @ v.T, points)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row_id"), pa.array(labels[choice]), list_array(block)],
                    ["row_id", "label", "vec"],
                )

    return map_arrow(
        rows.select("row_id", "vec"), assign, "row_id bigint, label int, vec array<double>"
    )


def sketch_labels(rows: DataFrame, l: int, ks: list[int], seed: int = 0, steps: int = 20):
    """(k, labelled original rows) for each k: clusters found on l coordinates per row, for all k at once.

    Only the coordinates are stored for the repeated passes of the training, not the rows.
    """
    v, found = _on_sketch(rows, l, ks, seed, steps)
    for k in ks:
        yield k, label_by_reduced(rows, v, centers_frame(rows, found[k]))


def _on_sketch(rows: DataFrame, l: int, ks: list[int], seed: int, steps: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    v = reduction(rows, l)
    features = stored(project_rows(rows, v, reduced=True), "features")
    return v, lloyd_grid(features, seeds(features, ks, seed), steps, TOLERANCE)


def kmeans_on_sketch(rows: DataFrame, l: int, ks: list[int], seed: int = 0, steps: int = 20) -> DataFrame:
    """Cluster the reduced rows and score the labels on the originals, for each k; the full fit
    starts from the centres those labels imply. k, l, sketch_cost, full_cost. Every scan serves all k."""
    v, found = _on_sketch(rows, l, ks, seed, steps)
    kept = stored(rows.select("row_id", "vec"), "kmeans")
    width = v.shape[1]
    implied, sketch_cost = {}, {}
    for k, total in grid_sums(kept, found, onto=v).items():
        total = total[total[:, width] > 0]
        implied[k] = total[:, :width] / total[:, width : width + 1]
        # squared norms less those of the means, by label
        sketch_cost[k] = float((total[:, width + 1] - (total[:, :width] * implied[k]).sum(axis=1)).sum())
    full = lloyd_grid(kept, implied, steps, TOLERANCE)
    costs = [(k, l, sketch_cost[k], float(total[:, -1].sum())) for k, total in grid_sums(kept, full).items()]
    return rows.sparkSession.createDataFrame(costs, "k int, l int, sketch_cost double, full_cost double")
