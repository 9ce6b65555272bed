"""Projections, filters, products and row sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sq_norm
from ..layouts import entries_to_rows, entries_to_sparse_rows, rows_to_entries, sparse_rows_to_entries, transpose
from ..operators import algebra as A
from ..operators.checks import entries_profile, matrix_profile, row_sums, sparse_profile
from ..operators.products import matmul_blocks as matmul_in_blocks
from ..session import stored
from .registry import (
    ACCOUNTS, EMB, HOURS, LINES, account_entries, cells, embeddings, entries_out, labelled, line_matrix,
    query, rounded, sql_cells, sql_rounded, table,
)

_LINE_CELLS = (
    f"(SELECT i, CAST(generate_subscripts([c0, c1, c2, c3], 1) - 1 AS INTEGER) AS j, unnest([c0, c1, c2, c3]) AS v FROM {LINES})"
)


@query("row_slice", sql_cells(f"{_LINE_CELLS} WHERE i BETWEEN 8000 AND 64000", 8))
def row_slice(spark, sf):
    return cells(A.row_slice(line_matrix(spark, sf), 8000, 64000), 8)


@query("truncate_rows", sql_cells(f"{EMB} WHERE i < 200"))
def truncate_rows(spark, sf):
    return cells(A.truncate_rows(embeddings(spark, sf), 200))


@query("truncate_cols", sql_cells(f"{EMB} WHERE j < 10"))
def truncate_cols(spark, sf):
    return cells(A.truncate_cols(embeddings(spark, sf), 10))


@query("nonzero_rows", f"SELECT i AS row_id FROM {LINES} WHERE c2 <> 0 OR c3 <> 0")
def nonzero_rows(spark, sf):
    rates = line_matrix(spark, sf).withColumn("vec", F.slice("vec", 3, 2))
    return A.nonzero_rows(rates)


_PURCHASES = "(SELECT user_id FROM events WHERE event_type = 'purchase')"


@query("zero_rows", f"SELECT DISTINCT user_id AS row_id FROM events WHERE user_id NOT IN {_PURCHASES}")
def zero_rows(spark, sf):
    events = table(spark, sf, "events")
    entries = events.filter("event_type = 'purchase'").select(
        F.col("user_id").alias("i"), F.lit(0).alias("j"), F.lit(1.0).alias("v")
    )
    return A.zero_rows(events.select(F.col("user_id").alias("row_id")).distinct(), entries)


@query("to_sparse", sql_cells(f"{_LINE_CELLS} WHERE v <> 0", 8))
def to_sparse(spark, sf):
    return entries_out(rows_to_entries(line_matrix(spark, sf)), 8)


_DENSE = f"""
SELECT u.i AS i, CAST(h.j AS INTEGER) AS j, round(coalesce(a.v, 0), 6) + 0.0 AS v
FROM (SELECT DISTINCT user_id AS i FROM events) u CROSS JOIN (SELECT unnest(range({HOURS})) AS j) h
LEFT JOIN {ACCOUNTS} a ON a.i = u.i AND a.j = h.j
"""


@query("to_dense", _DENSE)
def to_dense(spark, sf):
    ids = table(spark, sf, "events").select(F.col("user_id").alias("row_id")).distinct()
    return cells(entries_to_rows(account_entries(spark, sf), HOURS, ids))


@query("sparse_row_layout", sql_cells(f"{ACCOUNTS} WHERE v <> 0"))
def sparse_row_layout(spark, sf):
    return entries_out(sparse_rows_to_entries(entries_to_sparse_rows(account_entries(spark, sf))))


@query("transpose", f"SELECT CAST(j AS BIGINT) AS i, CAST(i AS INTEGER) AS j, {sql_rounded('v')} AS v FROM {ACCOUNTS}")
def transpose_query(spark, sf):
    return entries_out(transpose(account_entries(spark, sf)))


@query("scalar_mult", f"SELECT i, j, {sql_rounded('v * 3.2')} AS v FROM {EMB}")
def scalar_mult(spark, sf):
    return cells(A.scalar_mult(embeddings(spark, sf), 3.2))


@query("diag_mult", f"SELECT i, j, {sql_rounded('v * (label + 1)')} AS v FROM {EMB}")
def diag_mult(spark, sf):
    diagonal = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"), (F.col("label") + 1).cast("double").alias("d")
    )
    return cells(A.diag_mult(diagonal, embeddings(spark, sf)))


@query("vector_sq_norm", f"SELECT i AS row_id, {sql_rounded('sum(v * v)')} AS sq_norm FROM {EMB} GROUP BY i")
def vector_sq_norm(spark, sf):
    return embeddings(spark, sf).select("row_id", rounded(sq_norm(F.col("vec"))).alias("sq_norm"))


@query(
    "validate_matrix",
    f"""
SELECT count(*) AS n, 4 AS min_width, 4 AS max_width, 0::BIGINT AS null_rows, 0::BIGINT AS bad_rows,
 count(*) FILTER (c0 = 0 AND c1 = 0 AND c2 = 0 AND c3 = 0) AS zero_rows,
 count(*) FILTER (round(c0 + c1 + c2 + c3, 7) = 0 AND NOT (c0 = 0 AND c1 = 0 AND c2 = 0 AND c3 = 0)) AS cancelling_rows
FROM {LINES}
""",
)
def validate_matrix(spark, sf):
    return matrix_profile(line_matrix(spark, sf))


@query(
    "validate_sparse",
    f"SELECT layout, count(DISTINCT i) AS n, CAST(count(*) AS BIGINT) AS entries, 0::BIGINT AS bad_entries, "
    f"CAST(count(*) FILTER (j >= 700) AS BIGINT) AS outside_entries, 0::BIGINT AS repeated_entries FROM {ACCOUNTS}, (SELECT unnest(['rows', 'entries']) AS layout) GROUP BY layout",
)
def validate_sparse(spark, sf):
    """Profiles of both sparse layouts against fewer columns than there are: late hours lie outside."""
    entries = account_entries(spark, sf)
    columns = ["n", "entries", "bad_entries", "outside_entries", "repeated_entries"]
    rows = sparse_profile(entries_to_sparse_rows(entries), 700).select(F.lit("rows").alias("layout"), *columns)
    return rows.unionByName(entries_profile(entries, 700).select(F.lit("entries").alias("layout"), *columns))


@query(
    "column_sums_profile",
    f"SELECT i AS row_id, {sql_rounded('sum(v)', 7)} AS row_sum, (round(sum(v), 7) = 0 AND max(abs(v)) > 0) AS cancels FROM {EMB} GROUP BY i",
)
def column_sums_profile(spark, sf):
    return row_sums(embeddings(spark, sf)).select("row_id", (F.col("row_sum") + 0.0).alias("row_sum"), "cancels")


@query(
    "approx_equal",
    f"SELECT {sql_rounded('max(abs(v - round(v, 3)))')} AS max_diff, max(abs(v - round(v, 3))) < 1e-3 AS equal FROM {EMB}",
)
def approx_equal(spark, sf):
    rows = embeddings(spark, sf)
    coarse = rows.withColumn("vec", F.transform("vec", lambda x: F.round(x, 3)))
    return A.approx_equal(rows_to_entries(rows), rows_to_entries(coarse), 1e-3).select(
        rounded("max_diff").alias("max_diff"), "equal"
    )


@query(
    "matmul",
    f"""
SELECT a.i AS i, b.i AS j, round(sum(a.v * b.v), 4) + 0.0 AS v FROM {ACCOUNTS} a
JOIN (SELECT CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS i,
  CAST((day(ts) - 1) * 24 + hour(ts) AS INTEGER) AS j, value AS v FROM events) b ON a.j = b.j GROUP BY ALL
""",
)
def matmul(spark, sf):
    events = table(spark, sf, "events")
    hour = ((F.dayofmonth("ts") - 1) * 24 + F.hour("ts")).cast("bigint")
    from ..sources.tables import dictionary

    by_type = events.groupBy(hour.alias("i"), "event_type").agg(F.sum("value").alias("v"))
    right = by_type.join(dictionary(events, "event_type"), "event_type").select("i", "j", "v")
    return entries_out(A.matmul(account_entries(spark, sf), right), 4)


_SHIPPED = "(SELECT l_suppkey AS i, CAST(l_partkey AS INTEGER) AS j, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)"
_BY_FLAG = "(SELECT l_orderkey AS i, CAST(ascii(l_returnflag) AS INTEGER) AS j, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)"
_FLAG_STATES = "(SELECT CAST(ascii(l_returnflag) AS INTEGER) AS i, CAST(ascii(l_linestatus) AS INTEGER) AS j, sum(l_tax) AS v FROM lineitem GROUP BY ALL)"


@query(
    "matmul_blocks",
    f"""
SELECT 'suppliers by shared parts' AS product, a.i AS i, CAST(b.i AS INTEGER) AS j, round(sum(a.v * b.v), 4) + 0.0 AS v
FROM {_SHIPPED} a JOIN {_SHIPPED} b ON a.j = b.j GROUP BY ALL
UNION ALL SELECT 'orders by status', a.i, b.j, round(sum(a.v * b.v), 4) + 0.0 FROM {_BY_FLAG} a JOIN {_FLAG_STATES} b ON a.j = b.i GROUP BY ALL
""",
)
def matmul_blocks(spark, sf):
    """A product of two sparse matrices over many inner indexes, and one over few hot ones (a return flag
    has a third of all entries), which are laid over blocks."""
    lines = table(spark, sf, "lineitem")
    flag, status = F.ascii("l_returnflag"), F.ascii("l_linestatus")
    shipped = lines.groupBy(F.col("l_suppkey").alias("i"), F.col("l_partkey").cast("int").alias("j")).agg(F.sum("l_quantity").alias("v"))
    shipped = stored(shipped, "shipped")
    by_flag = lines.groupBy(F.col("l_orderkey").alias("i"), flag.alias("j")).agg(F.sum("l_quantity").alias("v"))
    by_flag = stored(by_flag, "by-flag")
    states = lines.groupBy(flag.cast("bigint").alias("i"), status.alias("j")).agg(F.sum("l_tax").alias("v"))
    suppliers = matmul_in_blocks(shipped, transpose(shipped)).withColumn("product", F.lit("suppliers by shared parts"))
    orders = matmul_in_blocks(by_flag, states).withColumn("product", F.lit("orders by status"))
    return suppliers.unionByName(orders).select("product", "i", "j", rounded("v", 4).alias("v"))


_CENTER = f"(SELECT label, j, avg(v) AS c FROM {EMB} GROUP BY label, j)"


@query(
    "matmul_small",
    f"SELECT e.i AS i, c.label AS j, {sql_rounded('sum(e.v * c.c)')} AS v FROM {EMB} e JOIN {_CENTER} c ON e.j = c.j GROUP BY ALL",
)
def matmul_small(spark, sf):
    from ..operators.clustering import centers_array, compute_centers

    _, centers = centers_array(compute_centers(labelled(spark, sf)))
    return cells(A.matmul_small(embeddings(spark, sf), centers.T))


_TWO = """
(SELECT user_id AS i, CAST(hour(ts) AS INTEGER) AS j, sum(value) AS v FROM events WHERE event_type = 'click' GROUP BY ALL) a
FULL JOIN (SELECT user_id AS i, CAST(hour(ts) AS INTEGER) AS j, sum(value) AS v FROM events WHERE event_type = 'view' GROUP BY ALL) b
ON a.i = b.i AND a.j = b.j"""


def _typed(spark, sf, kind):
    events = table(spark, sf, "events").filter(F.col("event_type") == kind)
    return events.groupBy(F.col("user_id").alias("i"), F.hour("ts").alias("j")).agg(F.sum("value").alias("v"))


@query("mat_add", f"SELECT coalesce(a.i, b.i) AS i, coalesce(a.j, b.j) AS j, {sql_rounded('coalesce(a.v, 0) + coalesce(b.v, 0)')} AS v FROM {_TWO}")
def mat_add(spark, sf):
    return entries_out(A.mat_add(_typed(spark, sf, "click"), _typed(spark, sf, "view")))


@query("mat_sub", f"SELECT coalesce(a.i, b.i) AS i, coalesce(a.j, b.j) AS j, {sql_rounded('coalesce(a.v, 0) - coalesce(b.v, 0)')} AS v FROM {_TWO}")
def mat_sub(spark, sf):
    return entries_out(A.mat_sub(_typed(spark, sf, "click"), _typed(spark, sf, "view")))


@query(
    "bucketize_rows",
    """
WITH u AS (SELECT DISTINCT l_suppkey AS i FROM lineitem), r AS (SELECT i, row_number() OVER (ORDER BY i) - 1 AS k, count(*) OVER () AS n FROM u)
SELECT i, CAST(k * 8 // n AS INTEGER) AS bucket, cnt AS lines FROM r JOIN (SELECT l_suppkey AS i, count(*) AS cnt FROM lineitem GROUP BY 1) USING (i)
""",
)
def bucketize_rows(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("i"))
    starts = A.bucket_starts(lines, "i", 8)
    counted = lines.groupBy("i").agg(F.count("*").alias("lines"))
    return A.bucketize(counted, "i", starts).select("i", "bucket", "lines")


@query(
    "vstack",
    f"""
SELECT i AS i, j, {sql_rounded('v')} AS v FROM {EMB}
UNION ALL SELECT i + (SELECT max(vec_id) + 1 FROM embeddings), j, {sql_rounded('v * 2')} FROM {EMB}
""",
)
def vstack(spark, sf):
    rows = embeddings(spark, sf)
    return cells(A.vstack(rows, A.scalar_mult(rows, 2.0)))


@query("distinct_row_ids", "SELECT l_suppkey AS i FROM lineitem UNION SELECT s_suppkey FROM supplier")
def distinct_row_ids(spark, sf):
    return A.distinct_row_ids(
        table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("i")),
        table(spark, sf, "supplier").select(F.col("s_suppkey").alias("i")),
    )
