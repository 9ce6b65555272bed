"""Tables derived from experiment results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mean_over_runs(results: DataFrame) -> DataFrame:
    return results.groupBy("variant", "param_value").agg(
        F.avg("time_s").alias("time_s"), F.avg("err").alias("err"), F.avg("proj_err").alias("proj_err")
    )


def speedup_vs_base(results: DataFrame) -> DataFrame:
    """Time at the smallest part count over time at each count, next to the ideal line."""
    w = Window.partitionBy("variant").orderBy("partitions")
    base = F.first("time_s").over(w)
    return results.select(
        "variant",
        "partitions",
        "time_s",
        (base / F.col("time_s")).alias("speedup"),
        (F.col("partitions") / F.first("partitions").over(w)).alias("ideal"),
    )


def cost_ratio_vs_opt(costs: DataFrame, base: str = "opt") -> DataFrame:
    """Cost of every variant over the cost of ``base`` at the same k."""
    best = F.max(F.when(F.col("variant") == base, F.col("cost"))).over(Window.partitionBy("k"))
    return costs.select("variant", "k", "cost", (F.col("cost") / best).alias("ratio"))


def bound_lines(results: DataFrame, names: tuple[str, str] = ("l1", "l2")) -> DataFrame:
    """Errors of the change points with the two baseline errors alongside (one baseline row)."""
    low, high = names
    lines = results.agg(
        F.max(F.when(F.col("variant") == low, F.col("err"))).alias("low_err"),
        F.max(F.when(F.col("variant") == high, F.col("err"))).alias("high_err"),
    )
    pair = lines.select(F.struct("low_err", "high_err").alias("p")).scalar()
    return (
        results.filter(~F.col("variant").isin(low, high))
        .withColumn("p", pair)
        .select("param_value", "err", F.col("p.low_err").alias("low_err"), F.col("p.high_err").alias("high_err"))
    )


def changepoint_split(rows: DataFrame, change_at: int) -> DataFrame:
    return rows.withColumn("phase", F.when(F.col("row_id") < change_at, 1).otherwise(2))


def sort_results(results: DataFrame) -> DataFrame:
    return results.orderBy("variant", "param_value")
