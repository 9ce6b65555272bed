"""Near-duplicate vectors through an inverted multi-index.

Two codebooks, one for each half of the vectors, are fitted to a bounded sample; their product is a
grid of cells, and every vector is kept in the cell of its two nearest centroids. Each vector visits
cells in the order of the sum of its two squared distances to their centroids (multi-sequence
traversal: of the cells at ranks a and b of the two sorted halves only those with
(a + 1)(b + 1) <= visits can be among the first). The number of visits is the least with which vectors
moved to exactly the threshold's distance are found again with the target recall; closer ones are found
more often. What a visit meets is verified with exact cosines, in blocks of vectors.

Equal vectors are one class that takes part once, with its number of copies. Of two cells the one
with the smaller number visits the other, so a pair is met once. Neighbouring cells (one centroid of the
first book, and a range of the second, which is ordered along its longest axis) form a tract of about ``TRACT``
vectors. A vector is sent once to each tract it visits, with the cells it visits there, and in the precision
it was given in. Tracts and their visitors are split into blocks of about ``BLOCK`` rows by a hash of the
id, so that no task holds a whole one. A block pair gives counts and a spanning star of its links, not the
links, so its output is linear too.

Vectors of each length are indexed by themselves, one length after the other.

Defined results: a vector that is null, empty, zero, or holds a null or non-finite component links with
nothing, and so do vectors of different lengths. Rows with one id are one vector for linking. Rows
without id get the component of their equals, null if these have none. An empty table gives an empty
result; only id and vector are read, whatever other columns are there.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import lookup, map_arrow, stored
from .blocks import runs
from .components import connected

COSINE = 0.95
#: Share of the pairs at exactly the threshold that the traversal must meet.
RECALL = 0.999
#: Vectors the codebooks are fitted to (and the bytes they may take), and those the number of visits is found with.
SAMPLE, SAMPLE_BYTES, TRIALS = 20_000, 64 << 20, 4_000
#: Centroids of a codebook, at most, and vectors a cell should hold until then.
CENTROIDS, CELL = 2048, 200
#: Vectors of a tract, about, and rows of one side of a block pair.
TRACT, BLOCK = 8192, 8192
#: Rows of an Arrow batch of vectors.
VECTOR_ROWS = 2048

_SIDE = 1024
_NO_CELL = np.iinfo(np.int64).max


@contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Arrow batches of few rows for jobs run inside, whose rows are whole blocks."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def squared_distances(a: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ centroids.T + (centroids * centroids).sum(1), 0)


def codebook(sample: np.ndarray, k: int, rng: np.random.Generator, steps: int = 12) -> np.ndarray:
    centroids = sample[rng.choice(len(sample), k, replace=False)].copy()
    for _ in range(steps):
        nearest = squared_distances(sample, centroids).argmin(1)
        order = np.argsort(nearest, kind="stable")
        used, heads = np.unique(nearest[order], return_index=True)
        centroids[used] = np.add.reduceat(sample[order], heads, axis=0) / np.diff(np.append(heads, len(sample)))[:, None]
    return centroids


class Grid:
    """Both codebooks, the number of visits, and how many cells in a row make a tract."""

    def __init__(self, sample: np.ndarray, n: int, cosine: float, recall: float):
        rng = np.random.default_rng(5)
        self.half = sample.shape[1] // 2
        k = int(np.clip(np.sqrt(n / CELL), 2, CENTROIDS))
        k = max(1, min(k, len(np.unique(sample, axis=0))))
        self.k = k
        self.books = [codebook(part, k, rng) for part in self.halves(sample)]
        centred = self.books[1] - self.books[1].mean(axis=0)
        self.books[1] = self.books[1][np.argsort(centred @ np.linalg.svd(centred, full_matrices=False)[2][0], kind="stable")]
        self.range = int(np.clip(TRACT * k * k // max(n, 1), 1, k))
        self.ranges = -(-k // self.range)
        at = sample[rng.choice(len(sample), TRIALS)]
        noise = rng.normal(size=at.shape)
        noise -= (noise * at).sum(1, keepdims=True) * at
        noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-300)
        moved = cosine * at + np.sqrt(1 - cosine * cosine) * noise
        ranks = np.empty(TRIALS, dtype=np.int64)
        for start in range(0, TRIALS, 256):
            first, second = self.distances(at[start : start + 256])
            theirs = self.cells(moved[start : start + 256])
            for n, cell in enumerate(theirs):  # cells that come before the moved vector's
                own = first[n, cell // k] + second[n, cell % k]
                ranks[start + n] = np.searchsorted(np.sort(second[n]), own - first[n], side="left").sum()
        ranks.sort()
        # rounding may count the cell itself or a tie, hence one more
        self.visits = int(min(k * k, ranks[min(TRIALS - 1, int(np.ceil(recall * TRIALS)))] + 2))

    def tract(self, cells: np.ndarray) -> np.ndarray:
        return cells // self.k * self.ranges + cells % self.k // self.range

    def halves(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return a[:, : self.half], a[:, self.half :]

    def distances(self, a: np.ndarray) -> list[np.ndarray]:
        return [squared_distances(part, book) for part, book in zip(self.halves(a), self.books)]

    def cells(self, a: np.ndarray) -> np.ndarray:
        first, second = (d.argmin(1) for d in self.distances(a))
        return first * self.k + second

    def nearest(self, a: np.ndarray) -> np.ndarray:
        """The first ``visits`` cells of the multi-sequence traversal of each vector, the own one first."""
        first, second = self.distances(a)
        one, two = np.argsort(first, axis=1), np.argsort(second, axis=1)
        i = np.concatenate([np.full(min(self.k, self.visits // (r + 1)), r) for r in range(min(self.k, self.visits))])
        j = np.concatenate([np.arange(min(self.k, self.visits // (r + 1))) for r in range(min(self.k, self.visits))])
        sums = np.take_along_axis(first, one, 1)[:, i] + np.take_along_axis(second, two, 1)[:, j]
        cells = one[:, i] * self.k + two[:, j]
        if sums.shape[1] > self.visits:
            best = np.argpartition(sums, self.visits - 1, axis=1)[:, : self.visits]
            cells = np.take_along_axis(cells, best, 1)
        return cells


def usable(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors of ``width`` components that are finite and not zero, and these as given."""
    given = column.type.value_type.to_pandas_dtype()
    lengths = pc.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False)
    places = np.flatnonzero(lengths == width)
    flat = column.take(pa.array(places)).flatten()
    a = flat.to_numpy(zero_copy_only=False).astype(given, copy=False).reshape(len(places), width)  # null: NaN
    good = np.isfinite(a).all(axis=1) & (a != 0).any(axis=1)
    return places[good], a[good]


def unit_rows(raw: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; by the largest component first, so that squares don't overflow."""
    a = raw.astype(np.float64)
    a = a / np.abs(a).max(axis=1, keepdims=True, initial=0)
    return a / np.linalg.norm(a, axis=1, keepdims=True)


def stars(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links from every id in a link to the smallest id it is connected with inside the block pair."""
    far = np.iinfo(np.int64).max
    a, b = linked.any(axis=1), linked.any(axis=0)
    linked, left, right = linked[np.ix_(a, b)], left[a], right[b]
    of_left = left.copy()
    while True:
        of_right = np.minimum(np.where(linked, of_left[:, None], far).min(axis=0, initial=far), right)
        fresh = np.minimum(np.where(linked, of_right[None, :], far).min(axis=1, initial=far), of_left)
        if (fresh == of_left).all():
            break
        of_left = fresh
    return [(int(i), int(r)) for i, r in zip([*left, *right], [*of_left, *of_right]) if i != r]


def clusters(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per row of ``vectors``: id (named as there), n_links, component_id and kept."""
    spark = vectors.sparkSession
    plain = vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("v"))
    classes = stored(
        plain.filter("v IS NOT NULL").groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "vector-classes"
    )

    given = vectors.select(vector).schema[0].dataType.elementType
    kind = "<f4" if isinstance(given, T.FloatType) else "<f8"

    def usable_rows(batches):
        for batch in batches:
            for width in sorted(set(pc.list_value_length(batch.column(2)).to_pylist()) - {0, None}):
                places, a = usable(batch.column(2), width)
                at = pa.array(places)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array([x.tobytes() for x in a.astype(kind)], pa.binary())],
                    names=["id", "copies", "raw"],
                )

    reps = stored(map_arrow(classes.select("id", "copies", numbers(given)).filter("id IS NOT NULL"), usable_rows, "id long, copies long, raw binary"), "vectors")
    counts = spark.createDataFrame([], "id long, links long")
    links = spark.createDataFrame([], "a long, b long")
    lengths = reps.groupBy(F.octet_length("raw").alias("bytes")).agg(F.count("*").alias("n")).filter("n > 1").orderBy("bytes").collect()
    for length in lengths:
        part = reps.filter(F.octet_length("raw") == length["bytes"])
        rows = max(2, min(SAMPLE, SAMPLE_BYTES // length["bytes"]))
        picked = part.select("id", "raw").orderBy(F.xxhash64("id"), "id").limit(rows).collect()
        sample = unit_rows(np.frombuffer(b"".join(bytes(r["raw"]) for r in picked), dtype=kind).reshape(len(picked), -1))
        found = met(part, Grid(sample, length["n"], cosine, recall), cosine, kind)
        counts, links = counts.unionByName(found[0]), links.unionByName(found[1])
    counts = counts.groupBy("id").agg(F.sum("links").alias("links")) if len(lengths) > 1 else counts
    labels = stored(connected(links), "vector-labels")
    of_class = (
        reps.select("id", "copies").join(counts, "id", "left").join(labels, "id", "left")
        .select("id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component"))
    )
    known = stored(
        classes.join(of_class.dropDuplicates(["id"]), "id").select(F.col("v").alias("cv"), "n_links", "component"), "vector-components"
    )
    return (
        plain.join(known, F.col("v") == F.col("cv"), "left")
        .select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
        .select(
            F.col("id").alias(id), "n_links", "component_id",
            F.when(F.col("component_id").isNull(), True).otherwise(F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))).alias("kept"),
        )
    )


def numbers(given: T.DataType):
    """The vectors ``v`` in a type that keeps their values: as they are, or whole numbers and decimals as doubles."""
    return F.col("v") if isinstance(given, (T.FloatType, T.DoubleType)) else F.col("v").cast("array<double>").alias("v")


def met(reps: DataFrame, grid: Grid, cosine: float, kind: str) -> tuple[DataFrame, DataFrame]:
    """(id, links) and (a, b) of all visits whose cosine reaches the threshold."""
    spark = reps.sparkSession
    shared = spark.sparkContext.broadcast(grid)

    def rows_of(column) -> np.ndarray:
        return unit_rows(np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), -1))

    def place(batches):
        known = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                a = rows_of(part.column(2))
                own, cells = known.cells(a), known.nearest(a)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(own, pa.int64()), pa.array(known.tract(own)), visits_of(known, own, cells)],
                    names=["id", "copies", "raw", "cell", "tract", "visits"],
                )

    schema = "id long, copies long, raw binary, cell long, tract long, visits array<struct<tract: long, cells: array<long>>>"
    placed = stored(map_arrow(reps, place, schema), "placed")
    visits = placed.select("id", "copies", "raw", "cell", F.explode("visits").alias("visit")).select("id", "copies", "raw", "cell", "visit.*")
    members = placed.groupBy("tract").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("of_members"))
    visitors = visits.groupBy("tract").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("of_visitors"))
    sizes = lookup(members.join(visitors, "tract"), "tracts")
    spot = F.xxhash64("id")
    x = visits.join(sizes, "tract").select(
        "tract", F.pmod(spot, "of_visitors").alias("i"), F.explode(F.expr("sequence(0L, cast(of_members as long) - 1)")).alias("j"),
        F.lit(True).alias("visitor"), "id", "copies", "raw", "cell", "cells",
    )
    y = placed.join(sizes, "tract").select(
        "tract", F.explode(F.expr("sequence(0L, cast(of_visitors as long) - 1)")).alias("i"), F.pmod(spot, "of_members").alias("j"),
        F.lit(False).alias("visitor"), "id", "copies", "raw", "cell", F.lit(None).cast("array<long>").alias("cells"),
    )
    work = x.unionByName(y).repartition("tract", "i", "j").sortWithinPartitions("tract", "i", "j")

    def verify(batches):
        for run in runs(batches, 3):
            visitor = run.column("visitor").to_numpy(zero_copy_only=False)
            some = run.filter(pa.array(visitor)), run.filter(pa.array(~visitor))
            if not some[0].num_rows or not some[1].num_rows:
                continue
            sides = [
                (*(t.column(c).to_numpy() for c in ("id", "copies", "cell")), rows_of(t.column("raw").combine_chunks())) for t in some
            ]
            lists = some[0].column("cells").combine_chunks()
            found = compare(sides, np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy(), cosine)
            if found is not None:
                yield found

    with small_batches(spark, VECTOR_ROWS):
        found = stored(map_arrow(work, verify, "id long, links long, root long"), "met")
    counts = found.filter("links IS NOT NULL").groupBy("id").agg(F.sum("links").alias("links"))
    return counts, found.filter("root IS NOT NULL").select(F.col("id").alias("a"), F.col("root").alias("b"))


def visits_of(grid: Grid, own: np.ndarray, cells: np.ndarray) -> pa.Array:
    """For each vector the tracts that it visits, with the cells there: its own cell, and those of ``cells``
    with a larger number."""
    cells = np.sort(np.concatenate([own[:, None], np.where(cells > own[:, None], cells, _NO_CELL)], axis=1), axis=1)
    row, at = np.nonzero(cells != _NO_CELL)
    cells = cells[row, at]
    tract = grid.tract(cells)  # in the order of the cells
    heads = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(tract, prepend=-1) != 0))
    lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(cells)), pa.int32()), pa.array(cells))
    entries = pa.StructArray.from_arrays([pa.array(tract[heads]), lists], names=["tract", "cells"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[heads], np.arange(len(own) + 1)), pa.int32()), entries)


def compare(sides, row: np.ndarray, cell: np.ndarray, cosine: float) -> pa.RecordBatch | None:
    """Counts and stars of the links between visitors and members of a block pair, cell by cell.

    ``sides`` are (id, copies, cell, unit) of visitors and members, ``row`` and ``cell`` the visits."""
    (left, left_copies, left_cell, a), (right, right_copies, right_cell, b) = sides
    order, visit = np.argsort(right_cell, kind="stable"), np.argsort(cell, kind="stable")
    row, cell = row[visit], cell[visit]
    n_left, n_right = np.zeros(len(left), dtype=np.int64), np.zeros(len(right), dtype=np.int64)
    pairs = []
    for c in np.unique(cell).tolist():
        y = order[np.searchsorted(right_cell, c, sorter=order) : np.searchsorted(right_cell, c, side="right", sorter=order)]
        x = row[np.searchsorted(cell, c) : np.searchsorted(cell, c, side="right")]
        if not len(y):
            continue
        for at in range(0, len(x), _SIDE):
            for to in range(0, len(y), _SIDE):
                p, q = x[at : at + _SIDE], y[to : to + _SIDE]
                near = a[p] @ b[q].T >= cosine
                # inside one cell every vector visits all, so a pair counts where its smaller id visits
                near &= np.where(left_cell[p] == c, 1, 0)[:, None] * (left[p][:, None] >= right[q][None, :]) == 0
                near &= left[p][:, None] != right[q][None, :]
                if near.any():
                    n_left[p] += near @ right_copies[q]
                    n_right[q] += near.T @ left_copies[p]
                    pairs += stars(near, left[p], right[q])
    if not pairs:
        return None
    ids = np.concatenate([left[n_left > 0], right[n_right > 0]])
    n = np.concatenate([n_left[n_left > 0], n_right[n_right > 0]])
    return pa.RecordBatch.from_arrays(
        [
            pa.array([*ids.tolist(), *(p[0] for p in pairs)], pa.int64()),
            pa.array([*n.tolist(), *([None] * len(pairs))], pa.int64()),
            pa.array([*([None] * len(ids)), *(p[1] for p in pairs)], pa.int64()),
        ],
        names=["id", "links", "root"],
    )
