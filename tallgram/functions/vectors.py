"""Per-row arithmetic on ARRAY<DOUBLE> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def required(value: Column, what: str = "element") -> Column:
    """The value, or an error where it is NULL."""
    return F.when(value.isNotNull(), value).otherwise(F.raise_error(F.lit(f"NULL {what} in the matrix")))


def sq_norm(vec: Column) -> Column:
    return F.aggregate(vec, F.lit(0.0), lambda total, x: total + x * x)


def vector_sum(vec: Column) -> Column:
    return F.aggregate(vec, F.lit(0.0), lambda total, x: total + x)


def sq_distance(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda total, d: total + d
    )


def shrink_value(sigma: Column, delta: Column, position: Column, spared: int = 0) -> Column:
    """Shrunk singular value; the first ``spared`` positions keep theirs."""
    return F.when(position < spared, sigma).otherwise(
        F.sqrt(F.greatest(sigma * sigma - delta, F.lit(0.0)))
    )
