"""Sources, sinks and generators."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sources as S
from ..operators.errors import sketch_and_score
from ..operators.kernels import Spec
from ..operators.sketch import sketch
from ..session import work_path
from .registry import (
    EMB, EMB_MASS, cells, embeddings, entries_out, line_id, query, rounded, sql_cells, sql_rounded,
    sql_uniform, table,
)


@query(
    "read_dense_text",
    f"SELECT dense_rank() OVER (ORDER BY i) - 1 AS i, j, CAST(printf('%.4f', v) AS DOUBLE) + 0.0 AS v FROM {EMB}",
)
def read_dense_text(spark, sf):
    path = work_path(spark, "dense")
    S.write_dense_text(embeddings(spark, sf), path)
    return cells(S.read_dense_text(spark, path), 4)


@query(
    "write_dense_text",
    "SELECT array_to_string(list_transform(embedding, lambda x: printf('%.4f', CAST(x AS DOUBLE))), ' ') AS line "
    "FROM embeddings UNION ALL SELECT '# ' || count(*) || ' ' || max(len(embedding)) FROM embeddings",
)
def write_dense_text(spark, sf):
    path = work_path(spark, "dense")
    S.write_dense_text(embeddings(spark, sf), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


_PIVOT = (
    "(SELECT user_id AS i, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS j, v FROM "
    "(SELECT user_id, event_type, sum(value) AS v FROM events GROUP BY ALL))"
)


def _pivot(spark, sf):
    return S.pivot_to_sparse(table(spark, sf, "events"), "user_id", "event_type", "value")


@query("read_matrix_market", sql_cells(_PIVOT))
def read_matrix_market(spark, sf):
    entries = _pivot(spark, sf)
    path = work_path(spark, "market")
    size = entries.agg(
        F.format_string("%d %d %d", F.max("i") + 1, F.max("j") + 1, F.count("*")).alias("size")
    )
    banner = F.lit("%%MatrixMarket matrix coordinate real general")
    head = size.select(F.concat(banner, F.lit("\n"), "size").alias("value"))
    body = entries.select(F.concat_ws(" ", F.col("i") + 1, F.col("j") + 1, "v").alias("value"))
    body.write.text(path)
    head.write.mode("append").text(path)
    return entries_out(S.read_matrix_market(spark, path))


@query(
    "read_word_vectors",
    "SELECT 'part' || p_partkey AS word, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y, "
    "CAST(length(p_name) AS DOUBLE) AS z FROM part",
)
def read_word_vectors(spark, sf):
    part = table(spark, sf, "part")
    path = work_path(spark, "words")
    body = part.select(
        F.concat_ws(
            " ", F.concat(F.lit("part"), "p_partkey"), "p_size", "p_retailprice", F.length("p_name")
        ).alias("value")
    )
    body.write.text(path)
    part.agg(F.format_string("%d 3", F.count("*")).alias("value")).write.mode("append").text(path)
    vec = F.col("vec")
    return S.read_word_vectors(spark, path).select(
        "word", vec[0].alias("x"), vec[1].alias("y"), vec[2].alias("z")
    )


@query(
    "stack_batches",
    """
WITH parts AS (SELECT 0 AS batch, s_suppkey AS r, s_acctbal AS v FROM supplier
  UNION ALL SELECT 1, c_custkey, c_acctbal FROM customer
  UNION ALL SELECT 2, p_partkey, p_retailprice FROM part),
sizes AS (SELECT batch, max(r) + 1 AS n FROM parts GROUP BY batch),
starts AS (SELECT batch, coalesce(sum(n) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM sizes)
SELECT batch, CAST(s + r AS BIGINT) AS row_id, v FROM parts JOIN starts USING (batch)
""",
)
def stack_batches(spark, sf):
    batches = [
        S.matrix_from_columns(table(spark, sf, "supplier"), "s_suppkey", ["s_acctbal"]),
        S.matrix_from_columns(table(spark, sf, "customer"), "c_custkey", ["c_acctbal"]),
        S.matrix_from_columns(table(spark, sf, "part"), "p_partkey", ["p_retailprice"]),
    ]
    return S.stack_batches(batches).select("batch", "row_id", F.col("vec")[0].alias("v"))


def _ids(spark, sf, name, column):
    return table(spark, sf, name).select(F.col(column).alias("row_id"))


@query(
    "gen_uniform_matrix",
    f"SELECT i, j, {sql_rounded(sql_uniform('i', 'j', 7))} AS v FROM "
    "(SELECT c_custkey AS i, unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS j FROM customer)",
)
def gen_uniform_matrix(spark, sf):
    return cells(S.uniform_matrix(_ids(spark, sf, "customer", "c_custkey"), 8, seed=7))


@query(
    "gen_sparse_matrix",
    f"SELECT i, j, {sql_rounded(sql_uniform('i', 'j', 4))} AS v FROM "
    "(SELECT o_orderkey AS i, CAST(unnest(range(50)) AS INTEGER) AS j FROM orders) "
    f"WHERE {sql_uniform('i', 'j', 3)} < 0.02",
)
def gen_sparse_matrix(spark, sf):
    return entries_out(S.sparse_uniform(_ids(spark, sf, "orders", "o_orderkey"), 50, 0.02, seed=3))


@query(
    "gen_structured_matrix",
    """
SELECT 'identity' AS kind, s_suppkey AS i, CAST(s_suppkey AS INTEGER) AS j, 1.0::DOUBLE AS v FROM supplier
UNION ALL SELECT 'diagonal', c_custkey, CAST(c_custkey AS INTEGER), c_acctbal + 0.0 FROM customer
UNION ALL SELECT 'index', s_suppkey, j, CAST(s_suppkey * 3 + j AS DOUBLE) FROM supplier, (SELECT unnest([0, 1, 2]) AS j)
UNION ALL SELECT 'zero', s_suppkey, j, 0.0::DOUBLE FROM supplier, (SELECT unnest([0, 1]) AS j)
""",
)
def gen_structured_matrix(spark, sf):
    ids = _ids(spark, sf, "supplier", "s_suppkey")
    diagonal = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("row_id"), F.col("c_acctbal").alias("d")
    )
    parts = {
        "identity": S.identity_matrix(ids),
        "diagonal": S.diagonal_matrix(diagonal),
        "index": cells(S.index_matrix(ids, 3)),
        "zero": cells(S.zero_matrix(ids, 2)),
    }
    out = None
    for kind, part in parts.items():
        tagged = part.select(F.lit(kind).alias("kind"), "i", "j", (F.col("v") + 0.0).alias("v"))
        out = tagged if out is None else out.unionByName(tagged)
    return out


@query(
    "sketch_save_load",
    f"""
WITH a AS (SELECT count(*) AS n, max(len(embedding)) AS m FROM embeddings), t AS {EMB_MASS}
SELECT kind, CAST(l AS INTEGER) AS l, CAST(m AS INTEGER) AS m, n AS n_rows, {sql_rounded('s', 4)} AS mass
FROM a, t, (VALUES ('batch_pfd', 8), ('batch_pfd', 16)) AS w(kind, l)
""",
)
def sketch_save_load(spark, sf):
    rows = embeddings(spark, sf, "float")
    path = work_path(spark, "sketches")
    specs = [
        Spec("batch_pfd", 8, alpha=0.2, grid_id=0),
        Spec("batch_pfd", 16, alpha=0.2, grid_id=1),
        Spec("fd", 16, grid_id=2),
    ]
    S.save_sketches(sketch(rows, specs), path, "embeddings")
    loaded = S.load_sketches(spark, path, dataset="embeddings", kind="batch_pfd")
    kept = F.aggregate("data", F.lit(0.0), lambda t, x: t + x * x)
    return loaded.select("kind", "l", "m", "n_rows", rounded(kept + F.col("mass_lost"), 4).alias("mass"))


@query(
    "sketch_cache_valid",
    """
WITH a AS (SELECT max(len(embedding)) AS m FROM embeddings),
r AS (SELECT * FROM (VALUES (8, 0), (16, 0), (16, 1), (32, 0)) AS w(l, extra))
SELECT 'fd' AS kind, CAST(l AS INTEGER) AS l, CAST(m + extra AS INTEGER) AS m, (extra = 0 AND l < 32) AS valid FROM r, a
""",
)
def sketch_cache_valid(spark, sf):
    rows = embeddings(spark, sf, "float")
    scored = sketch_and_score(rows, [Spec("fd", 8, grid_id=0), Spec("fd", 16, grid_id=1)])
    catalog = scored.withColumn("dataset", F.lit("embeddings"))
    m = rows.agg(F.max(F.size("vec")).alias("m"))
    wanted = F.array(*[F.struct(F.lit(l).alias("l"), F.lit(x).alias("x")) for l, x in ((8, 0), (16, 0), (16, 1), (32, 0))])
    requests = m.select("m", F.explode(wanted).alias("w")).select(
        F.lit("embeddings").alias("dataset"), F.lit("fd").alias("kind"), F.col("w.l").alias("l"),
        (F.col("m") + F.col("w.x")).alias("m"), (F.lit(2.0) / F.col("w.l")).alias("bound"),
    )
    return S.usable_sketches(requests, catalog).select("kind", "l", "m", "valid")


@query(
    "results_sink",
    f"""
SELECT event_type AS variant, CAST(day(ts) AS DOUBLE) AS param_value, CAST(hour(ts) AS INTEGER) AS run,
  {sql_rounded('avg(value)')} AS err FROM events GROUP BY ALL
""",
)
def results_sink(spark, sf):
    grouped = (
        table(spark, sf, "events")
        .groupBy("event_type", F.dayofmonth("ts").alias("d"), F.hour("ts").alias("h"))
        .agg(F.avg("value").alias("e"))
    )
    empty = F.lit(None).cast("double")
    results = grouped.select(
        F.lit("events").alias("exp"), F.lit("events").alias("dataset"),
        F.col("event_type").alias("variant"), F.lit("day").alias("param_name"),
        F.col("d").cast("double").alias("param_value"), F.col("h").alias("run"), F.lit(0).alias("l"),
        F.lit(0).alias("b"), empty.alias("alpha"), F.lit(1).alias("partitions"), empty.alias("time_s"),
        F.col("e").alias("err"), empty.alias("proj_err"), empty.alias("l_bound"),
    )
    path = work_path(spark, "results")
    S.append_results(results.filter("run < 12"), path)
    S.append_results(results.filter("run >= 12"), path)
    return spark.read.parquet(path).select("variant", "param_value", "run", rounded("err").alias("err"))


@query(
    "matrix_from_table",
    "SELECT l_orderkey * 8 + l_linenumber AS row_id, l_quantity AS c0, l_extendedprice AS c1, "
    "l_discount AS c2, l_tax AS c3 FROM lineitem",
)
def matrix_from_table(spark, sf):
    rows = S.matrix_from_columns(
        table(spark, sf, "lineitem"), line_id(), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    )
    return rows.select("row_id", *[F.col("vec")[n].alias(f"c{n}") for n in range(4)])


@query("matrix_from_vectors", sql_cells(EMB))
def matrix_from_vectors(spark, sf):
    return cells(embeddings(spark, sf))


@query("pivot_to_sparse", sql_cells(_PIVOT))
def pivot_to_sparse(spark, sf):
    return entries_out(_pivot(spark, sf))
