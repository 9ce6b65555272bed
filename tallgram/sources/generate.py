"""Seeded test matrices. Values depend on (seed, row, column) only, never on partitioning."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import uniform_hash
from ..session import expected_partitions, map_arrow

#: Cells a task draws at a time.
CELLS = 1 << 18


def uniform_matrix(row_ids: DataFrame, m: int, seed: int = 0) -> DataFrame:
    """Dense rows with entries uniform in (0, 1); elements of a null id are null."""
    columns, height = np.arange(m), max(1, CELLS // max(m, 1))

    def draw(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, height):
                ids = batch.column(0).slice(at, height)
                cells = uniform_hash(ids.fill_null(0).to_numpy()[:, None], columns[None, :], seed).ravel()
                unknown = np.repeat(ids.is_null().to_numpy(zero_copy_only=False), m)
                ends = pa.array(np.arange(len(ids) + 1) * m, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.ListArray.from_arrays(ends, pa.array(cells, mask=unknown))], ["row_id", "vec"]
                )

    kind = row_ids.schema["row_id"].dataType
    ids = row_ids.select(F.col("row_id").cast("bigint").alias("row_id"))
    drawn = map_arrow(ids.repartition(expected_partitions(ids)), draw, "row_id bigint, vec array<double>")
    return drawn.select(F.col("row_id").cast(kind).alias("row_id"), "vec")


def sparse_uniform(row_ids: DataFrame, m: int, density: float, seed: int = 0) -> DataFrame:
    """Entries kept with probability ``density``, values uniform in (0, 1).

    Cells are drawn in NumPy, ``CELLS`` at a time: as an expression the hash would be repeated for each of its
    powers. Ids are dealt out first, as a file of few bytes may stand for very many cells.
    """

    def draw(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for first in range(0, m, CELLS):
                columns = np.arange(first, min(m, first + CELLS))
                height = max(1, CELLS // len(columns))
                for at in range(0, len(ids), height):
                    rows = ids[at : at + height]
                    row, column = np.nonzero(uniform_hash(rows[:, None], columns[None, :], seed) < density)
                    i, j = rows[row], columns[column]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(i), pa.array(j.astype(np.int32)), pa.array(uniform_hash(i, j, seed + 1))], ["i", "j", "v"]
                    )

    kind = row_ids.schema["row_id"].dataType
    ids = row_ids.select(F.col("row_id").cast("bigint").alias("i")).filter("i IS NOT NULL")
    drawn = map_arrow(ids.repartition(expected_partitions(ids)), draw, "i bigint, j int, v double")
    return drawn.select(F.col("i").cast(kind).alias("i"), "j", "v")


def zero_matrix(row_ids: DataFrame, m: int) -> DataFrame:
    return row_ids.select("row_id", F.array_repeat(F.lit(0.0), m).alias("vec"))


def identity_matrix(row_ids: DataFrame) -> DataFrame:
    i = F.col("row_id")
    return row_ids.select(i.alias("i"), i.cast("int").alias("j"), F.lit(1.0).alias("v"))


def diagonal_matrix(diagonal: DataFrame) -> DataFrame:
    """Entries of diag(d) from ``diagonal(row_id, d)``."""
    i = F.col("row_id")
    return diagonal.select(i.alias("i"), i.cast("int").alias("j"), F.col("d").cast("double").alias("v"))


def index_matrix(row_ids: DataFrame, m: int) -> DataFrame:
    """Row-major running index 0, 1, 2, ... as values."""
    columns = F.sequence(F.lit(0), F.lit(m - 1))
    return row_ids.select(
        "row_id",
        F.transform(columns, lambda j: (F.col("row_id") * m + j).cast("double")).alias("vec"),
    )
