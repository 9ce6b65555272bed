"""Matrix algebra as DataFrame transformations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..layouts import ROWS, dense_block, list_array
from ..session import check_bytes, map_arrow, small_rows, stored


def row_slice(rows: DataFrame, start: int, end: int) -> DataFrame:
    """Rows start..end, both included; the filter reaches the scan."""
    return rows.filter(F.col("row_id").between(start, end))


def truncate_rows(rows: DataFrame, count: int) -> DataFrame:
    return rows.filter(F.col("row_id") < count)


def truncate_cols(rows: DataFrame, count: int) -> DataFrame:
    return rows.withColumn("vec", F.slice("vec", 1, count))


def nonzero_rows(rows: DataFrame) -> DataFrame:
    """Ids of rows with any non-zero element (row layout)."""
    return rows.filter(F.exists("vec", lambda x: x != 0)).select("row_id")


def distinct_row_ids(*entries: DataFrame) -> DataFrame:
    """Distinct ids of the rows that occur in any of the entry tables."""
    ids = entries[0].select("i")
    for other in entries[1:]:
        ids = ids.unionByName(other.select("i"))
    return ids.distinct()


def zero_rows(row_ids: DataFrame, entries: DataFrame) -> DataFrame:
    """Ids without any non-zero entry."""
    used = entries.filter(F.col("v") != 0).select(F.col("i").alias("row_id")).distinct()
    return row_ids.select("row_id").join(used, "row_id", "left_anti")


def scalar_mult(rows: DataFrame, factor: float) -> DataFrame:
    return rows.withColumn("vec", F.transform("vec", lambda x: x * factor))


def diag_mult(diagonal: DataFrame, rows: DataFrame) -> DataFrame:
    """diag(d) A for ``diagonal(row_id, d)``."""
    return rows.join(diagonal, "row_id").select(
        "row_id", F.transform("vec", lambda x: x * F.col("d")).alias("vec")
    )


def matmul(left: DataFrame, right: DataFrame) -> DataFrame:
    """Product in entry layout: equi-join on the inner index, terms summed on the map side.

    No broadcast is forced and nothing is packed per key, so a hot inner index is left to the skew
    split of adaptive execution. A tall matrix times a small one is ``matmul_small``.
    """
    inner = right.select(F.col("i").alias("inner"), F.col("j").alias("to"), F.col("v").alias("w"))
    met = left.join(inner, left.j == inner.inner)
    return met.groupBy("i", F.col("to").alias("j")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def matmul_small(rows: DataFrame, right: np.ndarray) -> DataFrame:
    """Tall dense rows times a small dense matrix that travels with the tasks: no shuffle."""
    right = np.ascontiguousarray(right, dtype=np.float64)
    check_bytes(right.nbytes, "the right-hand matrix")

    def multiply(batches):
        for batch in batches:
            if batch.num_rows:
                product = dense_block(batch.column("vec")) @ right
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row_id"), list_array(product)], ["row_id", "vec"]
                )

    return map_arrow(rows.select("row_id", "vec"), multiply, ROWS)


def linear_combination(a: DataFrame, b: DataFrame, fa: float, fb: float, shapes=None) -> DataFrame:
    """fa A + fb B in entry layout, one aggregation instead of an outer join.

    ``shapes`` ((n, m), (n, m)) makes differing shapes an error.
    """
    if shapes is not None and tuple(shapes[0]) != tuple(shapes[1]):
        raise ValueError(f"shapes differ: {shapes[0]} and {shapes[1]}")
    signed = a.select("i", "j", (F.col("v") * fa).alias("v")).unionByName(
        b.select("i", "j", (F.col("v") * fb).alias("v"))
    )
    return signed.groupBy("i", "j").agg(F.sum("v").alias("v"))


def mat_add(a: DataFrame, b: DataFrame, shapes=None) -> DataFrame:
    return linear_combination(a, b, 1.0, 1.0, shapes)


def mat_sub(a: DataFrame, b: DataFrame, shapes=None) -> DataFrame:
    return linear_combination(a, b, 1.0, -1.0, shapes)


def approx_equal(a: DataFrame, b: DataFrame, tol: float = 1e-4) -> DataFrame:
    """One row: largest elementwise difference and whether it is below ``tol``."""
    worst = F.coalesce(F.max(F.abs("v")), F.lit(0.0))
    return mat_sub(a, b).agg(worst.alias("max_diff"), (worst < tol).alias("equal"))


def ratio_close(x: Column, y: Column, tol: float = 0.1) -> Column:
    """Whether x / y lies within ``tol`` of one."""
    return F.abs(x / y - 1.0) <= tol


def vstack(top: DataFrame, bottom: DataFrame) -> DataFrame:
    """Rows of ``bottom`` below those of ``top``, renumbered."""
    height = top.agg(F.coalesce(F.max("row_id") + 1, F.lit(0)).alias("n")).scalar()
    return top.select("row_id", "vec").unionByName(
        bottom.select((F.col("row_id") + height).alias("row_id"), "vec")
    )


def numbered(ids: DataFrame, column: str) -> DataFrame:
    """Dense rank from zero of the distinct ids. The sort is range-partitioned; only the number of
    ids per range goes through a single-task window."""
    spread = ids.select(column).distinct().orderBy(column)
    ordered = stored(
        spread.withColumn("seq", F.monotonically_increasing_id()).withColumn(
            "part", F.shiftright("seq", 33)
        ),
        "numbered",
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        ordered.groupBy("part")
        .agg(F.count("*").alias("n"), F.min("seq").alias("first"))
        .select("part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    )
    # One row per sort partition, so the broadcast is bounded by spark.sql.shuffle.partitions.
    return ordered.join(F.broadcast(shifts), "part").select(
        column, (F.col("seq") + F.col("shift")).alias("rank")
    )


def bucket_starts(ids: DataFrame, column: str, buckets: int) -> list[int]:
    """First id of each of ``buckets`` ranges that hold equally many of the distinct ids."""
    ranked = numbered(ids, column)
    total = ranked.count()
    starts = sorted({-(-k * total // buckets) for k in range(buckets)} & set(range(total)))
    found = ranked.filter(F.col("rank").isin(starts)).select(column)
    return sorted(r[0] for r in small_rows(found, buckets, "the bucket starts"))


def bucketize(df: DataFrame, column: str, starts: list[int]) -> DataFrame:
    """Adds ``bucket``: the last range whose first id is not above the row's id."""
    edges = np.asarray(starts, dtype=np.int64)

    @F.pandas_udf("int")
    def locate(x):
        return x.__class__(np.maximum(np.searchsorted(edges, x.to_numpy(), side="right") - 1, 0))

    return df.withColumn("bucket", locate(F.col(column).cast("bigint")))
