"""Preconditions and data profile of a matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vector_sum


def matrix_profile(rows: DataFrame) -> DataFrame:
    """One row: count, width range, null and non-finite rows, rows cancelling to zero, zero rows."""
    vec = F.col("vec").cast("array<double>")
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = F.forall(vec, lambda x: x == 0)
    return rows.agg(
        F.count("*").alias("n"),
        F.min(F.size(vec)).alias("min_width"),
        F.max(F.size(vec)).alias("max_width"),
        F.count_if(F.col("vec").isNull()).alias("null_rows"),
        F.count_if(bad).alias("bad_rows"),
        F.count_if(zero).alias("zero_rows"),
        F.count_if((F.round(vector_sum(vec), 7) == 0) & ~zero).alias("cancelling_rows"),
    )


def sparse_profile(rows: DataFrame, m: int) -> DataFrame:
    """The same for sparse rows: count, entries, null rows, rows of unequal lists, and entries that are null
    or not finite, outside the m columns, or in a column that their row has already."""
    idx, val = F.coalesce("idx", F.array().cast("array<int>")), F.coalesce("val", F.array().cast("array<double>"))
    bad = F.filter(val.cast("array<double>"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    outside = F.filter(idx, lambda j: j.isNull() | (j < 0) | (j >= m))
    return rows.agg(
        F.count("*").alias("n"),
        F.sum(F.size(idx)).alias("entries"),
        F.count_if(F.col("idx").isNull() | F.col("val").isNull()).alias("null_rows"),
        F.count_if(F.size(idx) != F.size(val)).alias("uneven_rows"),
        F.sum(F.size(bad)).alias("bad_entries"),
        F.sum(F.size(outside)).alias("outside_entries"),
        F.sum(F.size(idx) - F.size(F.array_distinct(idx))).alias("repeated_entries"),
    )


def entries_profile(entries: DataFrame, m: int) -> DataFrame:
    """The same for entries: rows that occur, entries, nulls, values that are not finite, columns outside,
    and cells that occur again (one aggregation by cell, combined before it is exchanged)."""
    v = F.col("v").cast("double")
    cells = entries.groupBy("i", "j").agg(F.count("*").alias("c"), F.count_if(F.isnan(v) | (F.abs(v) == float("inf"))).alias("bad"), F.count_if(v.isNull()).alias("null"))
    rows = cells.groupBy("i").agg(
        F.sum("c").alias("c"), F.sum("bad").alias("bad"), F.sum(F.col("c") - 1).alias("again"),
        F.sum(F.when(F.col("i").isNull() | F.col("j").isNull(), F.col("c")).otherwise(F.col("null"))).alias("null"),
        F.sum(F.when((F.col("j") < 0) | (F.col("j") >= m), F.col("c")).otherwise(0)).alias("outside"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return rows.agg(
        F.count("i").alias("n"), total("c").alias("entries"), total("null").alias("null_entries"),
        total("bad").alias("bad_entries"), total("outside").alias("outside_entries"), total("again").alias("repeated_entries"),
    )


def row_sums(rows: DataFrame, digits: int = 7) -> DataFrame:
    """Sum of each row, and whether the row cancels to zero without being zero."""
    total = F.round(vector_sum(F.col("vec")), digits)
    cancels = (total == 0) & F.exists("vec", lambda x: x != 0)
    return rows.select("row_id", total.alias("row_sum"), cancels.alias("cancels"))


def validate_matrix(rows: DataFrame, l: int | None = None, strict: bool = False, m: int | None = None) -> tuple[int, int]:
    """(n, m) of a sound matrix, else ValueError. ``strict`` asks for l below both, not just at most.
    Sparse rows and entries need ``m``; n is then the number of rows given, or that have entries."""
    if "vec" not in rows.columns:
        if m is None:
            raise ValueError("sparse layouts need the number of columns m")
        p = (sparse_profile if "idx" in rows.columns else entries_profile)(rows, m).first()
        found = {name: n for name, n in p.asDict().items() if name not in ("n", "entries") and n}
        if found:
            raise ValueError("not a sound matrix: " + ", ".join(f"{n} {name.replace('_', ' ')}" for name, n in found.items()))
        n, width = p.n, m
    else:
        p = matrix_profile(rows).first()
        if p.null_rows or p.bad_rows:
            raise ValueError(f"{p.null_rows} null vectors, {p.bad_rows} with null, NaN or infinite elements")
        if p.min_width != p.max_width:
            raise ValueError(f"ragged vectors: widths {p.min_width} to {p.max_width}")
        n, width = p.n, p.max_width
    if n == 0:
        raise ValueError("the matrix has no rows")
    if l is not None:
        smaller = min(n, width)
        if l > smaller or (strict and l == smaller):
            raise ValueError(f"l={l} does not fit a {n} x {width} matrix")
    return n, width


def validate_parallel(n: int, parts: int) -> None:
    if not 1 <= parts <= n:
        raise ValueError(f"cannot split {n} rows into {parts} parts")
