"""Parameter sweeps and derived result tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..layouts import entries_to_sparse_rows
from ..plans import reports as P
from ..plans import sweeps as W
from ..session import stored
from .registry import (
    EMB_MASS, HOURS, LINES, account_entries, embeddings, line_matrix, query, rounded, sql_rounded, table,
)
from .clustering import single_cost


def _checked(results, extra=()):
    """Variant, parameter, exact mass and whether the error is within its certificate."""
    loses = F.col("variant").isin("randomized", "rand-batch-pfd")
    limit = F.when(loses, F.col("mass_lost")).otherwise(F.col("delta"))
    linear = F.col("variant").isin("jlt", "cw")
    fine = F.col("certified") & F.when(linear, F.col("err") < 1.5).otherwise(
        F.col("abs_err") <= limit + 1e-9 * F.col("sq_norm")
    )
    mass = F.when(linear, F.col("sq_norm")).otherwise(F.col("sketch_mass") + F.col("mass_lost"))
    return results.select(
        "variant", "param_value", "run", *extra, rounded(mass, 4).alias("mass"), fine.alias("err_le_delta")
    )


def _grid_sql(values: str) -> str:
    return (
        f"SELECT variant, CAST(p AS DOUBLE) AS param_value, CAST(r AS INTEGER) AS run, {sql_rounded('s', 4)} AS mass, "
        f"true AS err_le_delta FROM {EMB_MASS}, {values}"
    )


def _numbers(values) -> str:
    return "[" + ", ".join(str(v) for v in values) + "]"


def _variants(names, values, runs: int = 1) -> str:
    quoted = "[" + ", ".join(f"'{n}'" for n in names) + "]"
    return (
        f"(SELECT unnest({quoted}) AS variant) CROSS JOIN (SELECT unnest({_numbers(values)}) AS p) "
        f"CROSS JOIN (SELECT unnest(range({runs})) AS r)"
    )


ALPHAS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]


@query(
    "sweep_sketch_compare",
    _grid_sql(_variants(["jlt", "cw", "fd", "pfd", "batch-pfd", "rand-batch-pfd"], [8, 16, 24, 32])),
)
def sweep_sketch_compare(spark, sf):
    return _checked(W.sweep_sketch_compare(embeddings(spark, sf), [8, 16, 24, 32], 64))


@query("sweep_alpha", _grid_sql(_variants(["pfd"], ALPHAS)))
def sweep_alpha(spark, sf):
    return _checked(W.sweep_alpha(embeddings(spark, sf, "float"), 16, ALPHAS))


@query("sweep_batch_size", _grid_sql(_variants(["batch-fd"], [4, 8, 16, 32, 64, 128])))
def sweep_batch_size(spark, sf):
    return _checked(W.sweep_batch_size(embeddings(spark, sf, "float"), 16, [4, 8, 16, 32, 64, 128]))


@query("sweep_rand_vs_exact", _grid_sql(_variants(["exact", "randomized"], [4, 14, 24, 34, 44], 2)))
def sweep_rand_vs_exact(spark, sf):
    return _checked(W.sweep_rand_vs_exact(embeddings(spark, sf, "float"), 20, 0.2, [4, 14, 24, 34, 44], 2))


@query("sweep_tweak_vs_batch", _grid_sql(_variants(["tweak", "batch"], ALPHAS)))
def sweep_tweak_vs_batch(spark, sf):
    return _checked(W.sweep_tweak_vs_batch(embeddings(spark, sf, "float"), 16, ALPHAS))


@query("sweep_tweak_double", _grid_sql(_variants(["tweak", "batch"], [0.2, 0.6, 1.0])))
def sweep_tweak_double(spark, sf):
    return _checked(W.sweep_tweak_vs_batch(embeddings(spark, sf, "float"), 16, [0.2, 0.6, 1.0], double=True))


@query(
    "sweep_changepoint",
    f"SELECT variant, CAST(p AS DOUBLE) AS param_value, 0 AS run, l_in_range, {sql_rounded('s', 4)} AS mass, true AS err_le_delta "
    f"FROM {EMB_MASS}, (SELECT 'dynamic' AS variant, unnest(range(10)) * (SELECT count(*) // 10 FROM embeddings) + 1 AS p, true AS l_in_range "
    "UNION ALL SELECT unnest(['l1', 'l2']), 0, true)",
)
def sweep_changepoint(spark, sf):
    rows = embeddings(spark, sf, "float")
    step = rows.count() // 10
    out = W.sweep_changepoint(rows, 12, 24, 24, [k * step + 1 for k in range(10)])
    return _checked(out, [F.col("l_bound").between(12, 24).alias("l_in_range")])


@query("sweep_rand_scale", _grid_sql(_variants(["randomized"], [8, 16, 24, 32, 40])))
def sweep_rand_scale(spark, sf):
    checked = _checked(W.sweep_rand_scale(embeddings(spark, sf, "float"), [8, 16, 24, 32, 40], 200), ["time_s"])
    return checked.withColumn("err_le_delta", F.col("err_le_delta") & (F.col("time_s") > 0)).drop("time_s")


@query("sweep_partitions", _grid_sql(_variants(["exact", "randomized"], [2, 4, 8])))
def sweep_partitions(spark, sf):
    return _checked(W.sweep_partitions(embeddings(spark, sf, "float"), 16, 0.2, 40, [2, 4, 8]))


@query(
    "sweep_partitions_sparse",
    "SELECT variant, CAST(p AS DOUBLE) AS param_value, 0 AS run, round(s, 4) + 0.0 AS mass, true AS err_le_delta FROM "
    "(SELECT sum(v * v) AS s FROM (SELECT user_id, day(ts), hour(ts), sum(value) AS v FROM events GROUP BY ALL)), "
    "(SELECT unnest(['exact', 'randomized']) AS variant), (SELECT unnest([2, 4]) AS p)",
)
def sweep_partitions_sparse(spark, sf):
    sparse = stored(entries_to_sparse_rows(account_entries(spark, sf), summed=True), "sparse")
    return _checked(W.sweep_partitions(sparse, 8, 0.2, 16, [2, 4], m=HOURS))


@query(
    "sweep_clusters",
    "SELECT k, l, true AS ordered FROM (SELECT unnest([2, 4, 8]) AS k), (SELECT unnest([8, 16]) AS l), (SELECT count(*) FROM embeddings)",
)
def sweep_clusters(spark, sf):
    """A full fit costs at most what its start costs, and that is below the cost of one cluster."""
    rows = embeddings(spark, sf)
    single = single_cost(rows).first()[0]
    costs = W.sweep_clusters(rows, [2, 4, 8], [8, 16], seed=1)
    ordered = (F.col("full_cost") > 0) & (F.col("full_cost") <= F.col("sketch_cost") * 1.0000001) & (F.col("sketch_cost") < single)
    return costs.select("k", "l", ordered.alias("ordered"))


# Result tables are derived from lineitem: one "run" per line, timed by its quantity.


def _results(spark, sf):
    lines = table(spark, sf, "lineitem")
    return lines.select(
        F.col("l_returnflag").alias("variant"),
        F.col("l_linenumber").cast("double").alias("param_value"),
        F.col("l_quantity").alias("time_s"),
        F.col("l_discount").alias("err"),
        F.col("l_tax").alias("proj_err"),
    )


@query(
    "mean_over_runs",
    f"SELECT l_returnflag AS variant, CAST(l_linenumber AS DOUBLE) AS param_value, {sql_rounded('avg(l_quantity)')} AS time_s, {sql_rounded('avg(l_discount)')} AS err, {sql_rounded('avg(l_tax)')} AS proj_err FROM lineitem GROUP BY ALL",
)
def mean_over_runs(spark, sf):
    means = P.mean_over_runs(_results(spark, sf))
    return means.select("variant", "param_value", *[rounded(c).alias(c) for c in ("time_s", "err", "proj_err")])


@query(
    "speedup_vs_base",
    f"""
WITH t AS (SELECT l_returnflag AS variant, l_linenumber AS partitions, sum(l_quantity) AS time_s FROM lineitem GROUP BY ALL)
SELECT variant, partitions, {sql_rounded('time_s')} AS time_s,
 {sql_rounded('first_value(time_s) OVER w / time_s')} AS speedup,
 {sql_rounded('partitions::DOUBLE / first_value(partitions) OVER w')} AS ideal
FROM t WINDOW w AS (PARTITION BY variant ORDER BY partitions)
""",
)
def speedup_vs_base(spark, sf):
    timed = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_returnflag").alias("variant"), F.col("l_linenumber").alias("partitions"))
        .agg(F.sum("l_quantity").alias("time_s"))
    )
    return P.speedup_vs_base(timed).select(
        "variant", "partitions", *[rounded(c).alias(c) for c in ("time_s", "speedup", "ideal")]
    )


@query(
    "cost_ratio_vs_opt",
    f"""
WITH t AS (SELECT CASE o_orderstatus WHEN 'O' THEN 'opt' ELSE o_orderstatus END AS variant, month(o_orderdate) AS k, sum(o_totalprice) AS cost FROM orders GROUP BY ALL)
SELECT variant, CAST(k AS INTEGER) AS k, {sql_rounded('cost', 2)} AS cost, {sql_rounded("cost / max(CASE WHEN variant = 'opt' THEN cost END) OVER (PARTITION BY k)")} AS ratio FROM t
""",
)
def cost_ratio_vs_opt(spark, sf):
    variant = F.when(F.col("o_orderstatus") == "O", "opt").otherwise(F.col("o_orderstatus"))
    costs = (
        table(spark, sf, "orders")
        .groupBy(variant.alias("variant"), F.month("o_orderdate").alias("k"))
        .agg(F.sum("o_totalprice").alias("cost"))
    )
    return P.cost_ratio_vs_opt(costs).select(
        "variant", "k", rounded("cost", 2).alias("cost"), rounded("ratio").alias("ratio")
    )


@query(
    "bound_lines",
    f"""
WITH t AS (SELECT l_returnflag AS variant, CAST(l_linenumber AS DOUBLE) AS p, avg(l_discount) AS err FROM lineitem GROUP BY ALL)
SELECT p AS param_value, {sql_rounded('err')} AS err, {sql_rounded("(SELECT max(err) FROM t WHERE variant = 'A')")} AS low_err,
 {sql_rounded("(SELECT max(err) FROM t WHERE variant = 'R')")} AS high_err FROM t WHERE variant NOT IN ('A', 'R')
""",
)
def bound_lines(spark, sf):
    means = P.mean_over_runs(_results(spark, sf))
    return P.bound_lines(means, ("A", "R")).select(
        "param_value", *[rounded(c).alias(c) for c in ("err", "low_err", "high_err")]
    )


@query("changepoint_split", f"SELECT CASE WHEN i < 20000 THEN 1 ELSE 2 END AS phase, count(*) AS n, {sql_rounded('sum(c0)', 4)} AS s FROM {LINES} GROUP BY 1")
def changepoint_split(spark, sf):
    split = P.changepoint_split(line_matrix(spark, sf), 20000)
    return split.groupBy("phase").agg(
        F.count("*").alias("n"), rounded(F.sum(F.col("vec")[0]), 4).alias("s")
    )


@query(
    "sort_results",
    f"SELECT l_returnflag AS variant, CAST(l_linenumber AS DOUBLE) AS param_value, {sql_rounded('avg(l_discount)')} AS err FROM lineitem GROUP BY ALL ORDER BY 1, 2",
)
def sort_results(spark, sf):
    means = P.mean_over_runs(_results(spark, sf))
    return P.sort_results(means).select("variant", "param_value", rounded("err").alias("err"))
