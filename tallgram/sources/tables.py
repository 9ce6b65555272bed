"""Matrices from ordinary tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.algebra import numbered
from ..session import lookup


def matrix_from_vectors(df: DataFrame, row_id, vec: str, element: str = "double") -> DataFrame:
    """Row layout from an id and an array column. ``element="float"`` keeps 4-byte elements, which
    halves what the Arrow kernels receive; they compute in double either way."""
    key = row_id if isinstance(row_id, Column) else F.col(row_id)
    return df.select(
        key.cast("bigint").alias("row_id"), F.col(vec).cast(f"array<{element}>").alias("vec")
    )


def matrix_from_columns(df: DataFrame, row_id, columns: list) -> DataFrame:
    """Row layout from an id and numeric columns or expressions."""
    key = row_id if isinstance(row_id, Column) else F.col(row_id)
    cells = [c if isinstance(c, Column) else F.col(c) for c in columns]
    return df.select(
        key.cast("bigint").alias("row_id"), F.array(*[c.cast("double") for c in cells]).alias("vec")
    )


def dictionary(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of ``column`` numbered from zero in sorted order, NULL first: a range-partitioned
    sort, with one row per range in the numbering window."""
    return numbered(df, column).select(column, F.col("rank").cast("int").alias("j"))


def pivot_to_sparse(df: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Entries (i, j, v) with v = sum(value); i is the row key, j the rank of the column value.

    The facts are summed per (row, column value) first, so a popular pair is combined on the map
    side and the dictionary join sees each pair once. The dictionary is broadcast only after it
    has been measured. NULL is a category of its own.
    """
    cells = df.groupBy(row, column).agg(F.sum(F.col(value).cast("double")).alias("v"))
    names = lookup(dictionary(df, column), "dictionary").withColumnRenamed(column, "__name")
    return cells.join(names, F.col(column).eqNullSafe(F.col("__name"))).select(
        F.col(row).cast("bigint").alias("i"), "j", "v"
    )
