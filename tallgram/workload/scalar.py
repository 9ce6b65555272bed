"""Scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as C
from .registry import (
    EMB, labelled, query, rounded, sql_bucket, sql_gaussian, sql_mixed, sql_rounded, sql_sign, table,
)


def _orders(spark, sf):
    return table(spark, sf, "orders")


@query("hash_pairwise", f"SELECT o_orderkey AS x, {sql_bucket('o_orderkey', 97)} AS h FROM orders")
def hash_pairwise(spark, sf):
    return _orders(spark, sf).select(
        F.col("o_orderkey").alias("x"), C.pairwise_bucket(F.col("o_orderkey"), 97).alias("h")
    )


@query("hash_fourwise_sign", f"SELECT o_orderkey AS x, {sql_sign('o_orderkey')} AS h FROM orders")
def hash_fourwise_sign(spark, sf):
    return _orders(spark, sf).select(
        F.col("o_orderkey").alias("x"), C.fourwise_sign(F.col("o_orderkey")).alias("h")
    )


@query(
    "random_sign_bucket",
    f"SELECT o_orderkey AS x, {sql_mixed('o_orderkey', '0', 3)} % 2 * 2 - 1 AS sign, {sql_mixed('o_orderkey', '0', 4)} % 16 AS bucket FROM orders",
)
def random_sign_bucket(spark, sf):
    x = F.col("o_orderkey")
    return _orders(spark, sf).select(
        x.alias("x"), C.random_sign(x, 3).alias("sign"), C.random_bucket(x, 16, 3).alias("bucket")
    )


@query(
    "shrink_value",
    f"SELECT l_orderkey AS x, l_linenumber AS k, {sql_rounded('CASE WHEN l_linenumber < 3 THEN l_quantity ELSE sqrt(greatest(l_quantity * l_quantity - 400, 0)) END')} AS s FROM lineitem",
)
def shrink_value(spark, sf):
    lines = table(spark, sf, "lineitem")
    s = C.shrink_value(F.col("l_quantity"), F.lit(400.0), F.col("l_linenumber"), 3)
    return lines.select(F.col("l_orderkey").alias("x"), F.col("l_linenumber").alias("k"), rounded(s).alias("s"))


@query(
    "sq_distance",
    f"SELECT i AS row_id, {sql_rounded('sum((v - c) * (v - c))')} AS d FROM {EMB} e JOIN (SELECT j, avg(v) AS c FROM {EMB} GROUP BY j) USING (j) GROUP BY i",
)
def sq_distance(spark, sf):
    rows = labelled(spark, sf)
    mean = (
        rows.select(F.posexplode("vec").alias("j", "v")).groupBy("j").agg(F.avg("v").alias("c"))
        .agg(F.sort_array(F.collect_list(F.struct("j", "c")))["c"].alias("c"))
    )
    return rows.withColumn("mean", mean.scalar()).select(
        "row_id", rounded(C.sq_distance(F.col("vec"), F.col("mean"))).alias("d")
    )


@query("gaussian_hash", f"SELECT o_orderkey AS x, {sql_rounded(sql_gaussian('o_orderkey', '3', 9))} AS g FROM orders")
def gaussian_hash(spark, sf):
    x = F.col("o_orderkey")
    return _orders(spark, sf).select(x.alias("x"), rounded(C.gaussian_hash(x, 3, 9)).alias("g"))
