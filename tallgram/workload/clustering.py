"""k-means queries on the labelled embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clustering as K
from .registry import EMB, embeddings, labelled, query, rounded, sql_rounded

_C0 = f"c0 AS (SELECT label, j, avg(v) AS c FROM {EMB} GROUP BY label, j)"


def _assign(name: str, centers: str) -> str:
    """CTEs for the closest centre (lowest label on ties) of every row."""
    return (
        f"d_{name} AS (SELECT e.i, c.label, sum((e.v - c.c) * (e.v - c.c)) AS d FROM {EMB} e JOIN {centers} c ON e.j = c.j GROUP BY e.i, c.label), "
        f"{name} AS (SELECT i, arg_min(label, (d, label)) AS label, min(d) AS d FROM d_{name} GROUP BY i)"
    )


def _means(name: str, assigned: str) -> str:
    return f"{name} AS (SELECT a.label, e.j, avg(e.v) AS c FROM {EMB} e JOIN {assigned} a ON a.i = e.i GROUP BY a.label, e.j)"


@query("nearest_centroid", f"WITH {_C0}, {_assign('a', 'c0')} SELECT i AS row_id, label, {sql_rounded('d')} AS sq_dist FROM a")
def nearest_centroid(spark, sf):
    rows = labelled(spark, sf)
    found = K.nearest_centroid(rows, K.compute_centers(rows))
    return found.select("row_id", "label", rounded("sq_dist").alias("sq_dist"))


@query("label_join", f"WITH {_C0} SELECT i AS row_id, e.label AS label, {sql_rounded('sum(v * c)')} AS dot FROM {EMB} e JOIN c0 ON c0.label = e.label AND c0.j = e.j GROUP BY ALL")
def label_join(spark, sf):
    rows = labelled(spark, sf)
    joined = K.label_join(rows, K.compute_centers(rows))
    dot = F.aggregate(F.zip_with("vec", "center", lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)
    return joined.select("row_id", "label", rounded(dot).alias("dot"))


@query("kmeans_cost", f"WITH {_C0} SELECT {sql_rounded('sum((v - c) * (v - c))')} AS cost FROM {EMB} e JOIN c0 ON c0.label = e.label AND c0.j = e.j")
def kmeans_cost(spark, sf):
    rows = labelled(spark, sf)
    return K.kmeans_cost(rows, K.compute_centers(rows)).select(rounded("cost").alias("cost"))


@query("kmeans_cost_nearest", f"WITH {_C0}, {_assign('a', 'c0')} SELECT {sql_rounded('sum(d)')} AS cost FROM a")
def kmeans_cost_nearest(spark, sf):
    rows = labelled(spark, sf)
    return K.kmeans_cost_nearest(rows, K.compute_centers(rows)).select(rounded("cost").alias("cost"))


@query("compute_centers", f"WITH {_C0} SELECT label, j, {sql_rounded('c')} AS v FROM c0")
def compute_centers(spark, sf):
    centers = K.compute_centers(labelled(spark, sf))
    return centers.select("label", F.posexplode("center").alias("j", "v")).select(
        "label", "j", rounded("v").alias("v")
    )


@query("cost_from_labels", f"WITH {_C0} SELECT {sql_rounded('sum((v - c) * (v - c))')} AS cost, count(DISTINCT e.label) AS k FROM {EMB} e JOIN c0 ON c0.label = e.label AND c0.j = e.j")
def cost_from_labels(spark, sf):
    return K.cost_from_labels(labelled(spark, sf)).select(rounded("cost").alias("cost"), "k")


@query("distinct_labels", "SELECT count(DISTINCT label) AS k FROM embeddings")
def distinct_labels(spark, sf):
    return K.distinct_labels(labelled(spark, sf))


@query(
    "kmeans_warm_start",
    f"WITH {_C0}, {_assign('a1', 'c0')}, {_means('c1', 'a1')}, {_assign('a2', 'c1')}, {_means('c2', 'a2')} SELECT label, j, {sql_rounded('c')} AS v FROM c2",
)
def kmeans_warm_start(spark, sf):
    """Two Lloyd steps from the centres of the given labels."""
    rows = labelled(spark, sf)
    centers = K.lloyd(rows, K.compute_centers(rows), 2)
    return centers.select("label", F.posexplode("center").alias("j", "v")).select(
        "label", "j", rounded("v").alias("v")
    )


def single_cost(rows):
    """Cost of one cluster of all rows, a column of one row."""
    return K.cost_from_labels(rows.select(F.lit(0).alias("label"), "vec")).select(F.col("cost").alias("single"))


@query("kmeans_train", f"SELECT CAST(10 AS BIGINT) AS k, true AS below_total, true AS cost_agrees FROM (SELECT sum(v * v) AS s FROM {EMB})")
def kmeans_train(spark, sf):
    """The cost is that of the labels and centres given back, and below that of one cluster."""
    rows = embeddings(spark, sf)
    cost, centers, labels = K.kmeans_train(rows, 10, seed=1)
    own = K.kmeans_cost(labels, centers).scalar()
    k = centers.agg(F.count("*")).scalar()
    return single_cost(rows).select(
        k.alias("k"), (F.lit(cost) < F.col("single")).alias("below_total"),
        (F.abs(own / F.lit(cost) - 1) < 1e-6).alias("cost_agrees"),
    )


@query(
    "kmeans_on_sketch",
    "SELECT count(*) AS n, true AS labels_in_range, true AS below_single FROM embeddings",
)
def kmeans_on_sketch(spark, sf):
    """Labels of all rows, which cost less than one cluster of all rows does."""
    rows = embeddings(spark, sf)
    _, labels = next(K.sketch_labels(rows, 16, [10], seed=1))
    below = K.cost_from_labels(labels).select(F.col("cost").alias("own")).crossJoin(single_cost(rows)).select((F.col("own") < F.col("single")).alias("below_single"))
    return labels.agg(
        F.count("*").alias("n"),
        ((F.min("label") >= 0) & (F.max("label") < 10)).alias("labels_in_range"),
    ).crossJoin(below)
