"""The three layouts of a matrix and the conversions between them.

rows         row_id BIGINT, vec ARRAY<DOUBLE>
entries      i BIGINT, j INT, v DOUBLE            (an absent entry is zero)
sparse rows  row_id BIGINT, idx ARRAY<INT>, val ARRAY<DOUBLE>
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import expected_partitions, map_arrow

ROWS = "row_id bigint, vec array<double>"
ENTRIES = "i bigint, j int, v double"
SPARSE_ROWS = "row_id bigint, idx array<int>, val array<double>"
#: Column numbers that are counted at a time.
COUNTED = 1 << 18


def rows_to_entries(rows: DataFrame, keep_zeros: bool = False) -> DataFrame:
    out = rows.select(F.col("row_id").alias("i"), F.posexplode("vec").alias("j", "v"))
    out = out.select("i", "j", F.col("v").cast("double").alias("v"))
    return out if keep_zeros else out.filter(F.col("v") != 0)


def entries_to_sparse_rows(entries: DataFrame, summed: bool = False) -> DataFrame:
    """One row per non-zero matrix row. Duplicate (i, j) entries are added up first, with
    map-side combine, so a group never holds more than one entry per column."""
    if not summed:
        entries = entries.groupBy("i", "j").agg(F.sum("v").alias("v"))
    packed = (
        entries.filter(F.col("v") != 0)
        .groupBy("i")
        .agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("jv"))
    )
    return packed.select(
        F.col("i").alias("row_id"), F.col("jv.j").alias("idx"), F.col("jv.v").alias("val")
    )


def counted_rows(lists: DataFrame) -> DataFrame:
    """Sparse rows of how often each column number occurs in the lists ``row_id, idx`` of a row.

    Lists are counted where they are read, so what is exchanged are packed rows; rows of the same id are added up
    then. Partitions follow the size of the input, so none of them grows with it."""

    def count(batches):
        for batch in batches:
            sizes = np.diff(batch.column("idx").offsets.to_numpy())
            ends, start = np.cumsum(sizes), 0
            weights = "val" in batch.schema.names
            idx = batch.column("idx").flatten().to_numpy().astype(np.int64)
            val = batch.column("val").flatten().to_numpy() if weights else None
            while start < len(sizes):
                low = ends[start] - sizes[start]
                stop = max(start + 1, int(np.searchsorted(ends, low + COUNTED, side="right")))
                some, width = idx[low : ends[stop - 1]], idx[low : ends[stop - 1]].max(initial=0) + 1
                cell, at = np.unique(np.repeat(np.arange(stop - start), sizes[start:stop]) * width + some, return_inverse=True)
                total = np.bincount(at, weights=val[low : ends[stop - 1]] if weights else None, minlength=len(cell))
                edges = pa.array(np.searchsorted(cell, np.arange(stop - start + 1) * width), pa.int32())
                lists = [pa.array((cell % width).astype(np.int32)), pa.array(total.astype(np.float64))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row_id").slice(start, stop - start), *(pa.ListArray.from_arrays(edges, x) for x in lists)],
                    ["row_id", "idx", "val"],
                )
                start = stop

    packed = map_arrow(lists.select("row_id", "idx"), count, SPARSE_ROWS)
    together = packed.repartition(expected_partitions(lists), "row_id").groupBy("row_id")
    joined = together.agg(F.flatten(F.collect_list("idx")).alias("idx"), F.flatten(F.collect_list("val")).alias("val"))
    return map_arrow(joined, count, SPARSE_ROWS)


def sparse_rows_to_entries(sparse: DataFrame) -> DataFrame:
    return sparse.select(
        F.col("row_id").alias("i"), F.explode(F.arrays_zip("idx", "val")).alias("e")
    ).select("i", F.col("e.idx").alias("j"), F.col("e.val").alias("v"))


def sparse_rows_to_rows(sparse: DataFrame, m: int) -> DataFrame:
    """Dense rows of width ``m``; a narrow, batch-wise operation."""

    def densify(batches):
        for batch in batches:
            n = batch.num_rows
            idx, val = batch.column("idx"), batch.column("val")
            rows = np.repeat(np.arange(n), np.diff(idx.offsets.to_numpy()))
            dense = np.zeros((n, m))
            dense[rows, idx.flatten().to_numpy()] = val.flatten().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_id"), list_array(dense)], ["row_id", "vec"]
            )

    return map_arrow(sparse.select("row_id", "idx", "val"), densify, ROWS)


def entries_to_rows(entries: DataFrame, m: int, row_ids: DataFrame | None = None) -> DataFrame:
    """Dense rows; ``row_ids(row_id)`` adds the all-zero rows the entry layout does not store."""
    sparse = entries_to_sparse_rows(entries)
    if row_ids is not None:
        sparse = row_ids.select("row_id").join(sparse, "row_id", "left")
        sparse = sparse.select(
            "row_id",
            F.coalesce("idx", F.array().cast("array<int>")).alias("idx"),
            F.coalesce("val", F.array().cast("array<double>")).alias("val"),
        )
    return sparse_rows_to_rows(sparse, m)


def transpose(entries: DataFrame) -> DataFrame:
    """Rows and columns swapped. Column numbers are INT, so a row id beyond that raises."""
    fits = F.when(F.abs("i") < 2**31, F.col("i")).otherwise(F.raise_error(F.lit("a row id beyond INT can't be a column number")).cast("bigint"))
    return entries.select(F.col("j").cast("bigint").alias("i"), fits.cast("int").alias("j"), "v")


def list_array(matrix: np.ndarray) -> pa.ListArray:
    """Rows of a 2-D array as an Arrow list column."""
    n, m = matrix.shape
    return pa.ListArray.from_arrays(
        pa.array(np.arange(n + 1, dtype=np.int32) * m, pa.int32()),
        pa.array(np.ascontiguousarray(matrix, dtype=np.float64).ravel()),
    )


def dense_block(column: pa.ListArray) -> np.ndarray:
    """Arrow list column of equal-length finite vectors as an (n, m) float64 array.

    Nulls, ragged rows and non-finite values raise, which rejects bad input during the pass that
    reads it anyway.
    """
    if len(column) == 0:
        return np.zeros((0, 0))
    widths = np.diff(column.offsets.to_numpy())
    if column.null_count or (widths != widths[0]).any():
        raise ValueError("null or ragged vectors in the matrix")
    values = column.flatten()
    if values.null_count:
        raise ValueError("null elements in the matrix")
    block = values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if not np.isfinite(block).all():
        raise ValueError("NaN or infinite elements in the matrix")
    return block.reshape(len(column), int(widths[0]))
