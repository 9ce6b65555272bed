"""Norms, Gram matrices, spectra and error metrics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..layouts import entries_to_sparse_rows, rows_to_entries
from ..operators import errors as R
from ..operators import spectra as X
from ..operators.algebra import matmul, matmul_small
from ..operators.kernels import Spec
from ..operators.cache import cached_spectrum
from ..operators.sketch import sketch
from ..session import stored, work_path
from .registry import (
    ACCOUNT_MASS, ACCOUNTS, EMB, EMB_MASS, HOURS, LINE_MASS, account_entries, embeddings, entries_out,
    line_matrix, query, rounded, sql_rounded,
)


@query("sq_frobenius", f"SELECT {sql_rounded('s', 4)} AS sq_norm FROM {LINE_MASS}")
def sq_frobenius(spark, sf):
    return R.sq_frobenius(line_matrix(spark, sf)).select(rounded("sq_norm", 4).alias("sq_norm"))


@query("sq_frobenius_sparse", f"SELECT {sql_rounded('s', 4)} AS sq_norm FROM {ACCOUNT_MASS}")
def sq_frobenius_sparse(spark, sf):
    return R.sq_frobenius(account_entries(spark, sf)).select(rounded("sq_norm", 4).alias("sq_norm"))


@query(
    "gram",
    f"SELECT CAST(a.j AS BIGINT) AS i, b.j AS j, {sql_rounded('sum(a.v * b.v)')} AS v FROM {EMB} a JOIN {EMB} b ON a.i = b.i GROUP BY ALL",
)
def gram(spark, sf):
    return entries_out(X.gram(embeddings(spark, sf, "float")))


@query(
    "gram_sparse",
    f"SELECT CAST(a.j AS BIGINT) AS i, b.j AS j, {sql_rounded('sum(a.v * b.v)', 4)} AS v FROM {ACCOUNTS} a JOIN {ACCOUNTS} b ON a.i = b.i WHERE a.v <> 0 AND b.v <> 0 GROUP BY ALL",
)
def gram_sparse(spark, sf):
    return entries_out(X.gram_of_entries(account_entries(spark, sf), HOURS), 4)


_A = f"a AS (SELECT count(*) AS n, max(len(embedding)) AS m FROM embeddings), t AS {EMB_MASS}"


@query(
    "spectral_norm",
    f"WITH {_A} SELECT true AS at_most_frobenius, true AS at_least_mean, true AS agrees FROM a, t",
)
def spectral_norm(spark, sf):
    """Largest singular value twice (Gram matrix, Lanczos steps), between |A|_F / sqrt(m) and |A|_F."""
    rows = embeddings(spark, sf, "float")
    m = rows.select(F.size("vec").alias("m")).first().m
    top = F.max("sigma")
    lanczos = R.spectral_norm_wide(rows, m) ** 0.5
    total = F.sum(F.col("sigma") * F.col("sigma"))
    return X.thin_svd(rows).agg(
        (top * top <= total).alias("at_most_frobenius"),
        (top * top * m >= total).alias("at_least_mean"),
        (F.abs(top / F.lit(lanczos) - 1) < 1e-5).alias("agrees"),
    )


@query(
    "thin_svd",
    f"WITH {_A} SELECT CAST(m AS BIGINT) AS k, {sql_rounded('s', 4)} AS energy, true AS descending, CAST(m AS DOUBLE) AS vector_mass FROM a, t",
)
def thin_svd(spark, sf):
    svd = X.thin_svd(embeddings(spark, sf, "float"))
    square = F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x)
    order = F.sort_array(F.collect_list(F.struct("k", "sigma")))["sigma"]
    return svd.agg(
        F.count("*").alias("k"),
        rounded(F.sum(F.col("sigma") * F.col("sigma")), 4).alias("energy"),
        (order == F.sort_array(F.collect_list("sigma"), asc=False)).alias("descending"),
        rounded(F.sum(square), 4).alias("vector_mass"),
    )


_GRADES = "10 ** (-10.0 * j / (m - 1))"


@query(
    "thin_svd_graded",
    f"WITH {_A} SELECT CAST(m AS BIGINT) AS k, true AS agrees, {sql_rounded('(SELECT sum((v * ' + _GRADES + ') * (v * ' + _GRADES + ')) FROM ' + EMB + ')')} AS energy, CAST(m AS DOUBLE) AS vector_mass FROM a",
)
def thin_svd_graded(spark, sf):
    """Columns scaled over ten decades: every sigma, the smallest too, is the length of A v."""
    rows = embeddings(spark, sf)
    m = rows.select(F.size("vec").alias("m")).first().m
    rows = rows.select("row_id", F.transform("vec", lambda x, i: x * F.pow(F.lit(10.0), -10.0 * i / (m - 1))).alias("vec"))
    svd = stored(X.thin_svd(rows, m, method="qr"), "svd")
    _, v = X.small_svd(svd)
    lengths = matmul_small(rows, v.T).select(F.posexplode("vec").alias("k", "x")).groupBy("k").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("length"))
    square = F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x)
    return svd.join(lengths, "k").agg(
        F.count("*").alias("k"), F.every(F.abs(F.col("length") / F.col("sigma") - 1) < 1e-6).alias("agrees"),
        rounded(F.sum(F.col("sigma") * F.col("sigma"))).alias("energy"), rounded(F.sum(square), 4).alias("vector_mass"),
    )


@query(
    "cached_spectrum",
    f"WITH {_A}, first AS (SELECT embedding[1]::DOUBLE AS x FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) "
    f"SELECT step, step = 2 AS hit, CAST(m AS BIGINT) AS k, {sql_rounded('s + CASE WHEN step = 3 THEN (x + 1) * (x + 1) - x * x ELSE 0 END', 4)} AS energy "
    "FROM a, t, first, (SELECT unnest([1, 2, 3]) AS step)",
)
def cached_spectrum_query(spark, sf):
    """A miss that stores, a hit on the same rows in another order, and a miss after one changed row."""
    rows, folder = embeddings(spark, sf), work_path(spark, "spectra")
    least = rows.agg(F.min("row_id")).first()[0]
    changed = rows.withColumn(
        "vec", F.when(F.col("row_id") == least, F.transform("vec", lambda x, i: F.when(i == 0, x + 1).otherwise(x))).otherwise(F.col("vec"))
    )
    out = None
    for step, matrix in enumerate((rows, rows.repartition(3, "row_id"), changed), 1):
        svd, hit = cached_spectrum(matrix, folder)
        part = svd.agg(F.count("*").alias("k"), rounded(F.sum(F.col("sigma") * F.col("sigma")), 4).alias("energy"))
        part = part.select(F.lit(step).alias("step"), F.lit(hit).alias("hit"), "k", "energy")
        out = part if out is None else out.unionByName(part)
    return out


@query("left_vectors", f"WITH {_A} SELECT CAST(n AS BIGINT) AS n, CAST(m AS DOUBLE) AS mass FROM a")
def left_vectors(spark, sf):
    """U has orthonormal columns: its squared norm is the rank."""
    rows = embeddings(spark, sf, "float")
    u = X.left_vectors(rows, X.thin_svd(rows))
    square = F.aggregate("vec", F.lit(0.0), lambda t, x: t + x * x)
    return u.agg(F.count("*").alias("n"), rounded(F.sum(square), 4).alias("mass"))


@query("sorted_spectrum", f"WITH {_A} SELECT CAST(m AS BIGINT) AS k, {sql_rounded('s', 4)} AS energy FROM a, t")
def sorted_spectrum(spark, sf):
    svd = X.thin_svd(embeddings(spark, sf, "float")).orderBy(F.desc("sigma"))
    return svd.agg(
        F.count("*").alias("k"), rounded(F.sum(F.col("sigma") * F.col("sigma")), 4).alias("energy")
    )


@query(
    "topk_directions",
    f"WITH {_A} SELECT CAST(x AS INTEGER) AS k, true AS agrees FROM t, (SELECT unnest(range(10)) AS x)",
)
def topk_directions(spark, sf):
    rows = embeddings(spark, sf, "float")
    """sigma is the length of A v for each of the leading directions."""
    svd = stored(X.thin_svd(rows), "svd")
    top = X.top_directions(svd, 10)
    _, v = X.small_svd(top)
    lengths = matmul_small(rows, v.T).select(F.posexplode("vec").alias("k", "x")).groupBy("k").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("length"))
    close = F.abs(F.col("length") / F.col("sigma") - 1) < 1e-6
    return top.join(lengths, "k").select("k", (close & (F.col("sigma") > 0)).alias("agrees"))


@query(
    "randomized_svd",
    f"WITH {_A} SELECT CAST(8 AS BIGINT) AS k, true AS below_total, true AS top_agrees FROM t",
)
def randomized_svd(spark, sf):
    rows = embeddings(spark, sf, "float")
    m = rows.select(F.size("vec").alias("m")).first().m
    exact = X.thin_svd(rows).agg(F.max("sigma")).scalar()
    total = R.sq_frobenius(rows).scalar()
    top = F.max("sigma")
    return X.randomized_svd(rows, 8, m).agg(
        F.count("*").alias("k"),
        (F.sum(F.col("sigma") * F.col("sigma")) <= F.max(total)).alias("below_total"),
        (F.abs(top / F.max(exact) - 1) < 0.02).alias("top_agrees"),
    )


@query(
    "randomized_svd_sparse",
    f"SELECT CAST(8 AS BIGINT) AS k, true AS agrees FROM {ACCOUNT_MASS}",
)
def randomized_svd_sparse(spark, sf):
    entries = account_entries(spark, sf)
    sparse = stored(entries_to_sparse_rows(entries, summed=True), "sparse")
    svd = X.randomized_svd(sparse, 8, HOURS, power=2)
    exact = X.thin_svd(sparse, HOURS).select("k", F.col("sigma").alias("exact"))
    ratio = F.col("sigma") / F.col("exact")
    return svd.join(exact, "k").agg(F.count("*").alias("k"), F.min(ratio.between(0.9, 1 + 1e-9)).alias("agrees"))


@query(
    "cov_error",
    f"WITH {_A} SELECT CAST(m AS INTEGER) AS m, {sql_rounded('s', 4)} AS sq_norm, true AS err_le_delta, true AS err_le_bound FROM a, t",
)
def cov_error(spark, sf):
    scored = R.sketch_and_score(embeddings(spark, sf, "float"), Spec("fd", 16))
    return scored.select(
        "m",
        rounded("sq_norm", 4).alias("sq_norm"),
        (F.col("certified") & (F.col("abs_err") <= F.col("delta") + 1e-9 * F.col("sq_norm"))).alias("err_le_delta"),
        (F.col("abs_err") <= R.fd_bound(F.col("sq_norm"), 16)).alias("err_le_bound"),
    )


@query(
    "cov_error_sparse",
    f"SELECT {sql_rounded('s', 4)} AS sq_norm, true AS err_le_delta FROM {ACCOUNT_MASS}",
)
def cov_error_sparse(spark, sf):
    """Sparse matrix: block Krylov steps on A'A - B'B, no m x m matrix anywhere."""
    sparse = stored(entries_to_sparse_rows(account_entries(spark, sf), summed=True), "sparse")
    state = sketch(sparse, Spec("sparse_batch_pfd", 8, b=32, alpha=0.5), m=HOURS)
    return R.score_wide(sparse, state, HOURS).select(
        rounded("sq_norm", 4).alias("sq_norm"),
        (F.col("certified") & (F.col("abs_err") <= F.col("delta") + 1e-6 * F.col("sq_norm"))).alias("err_le_delta"),
    )


@query(
    "low_rank_sketch",
    f"WITH {_A} SELECT CAST(x AS INTEGER) AS k, true AS agrees FROM t, (SELECT unnest(range(8)) AS x)",
)
def low_rank_sketch(spark, sf):
    rows = embeddings(spark, sf, "float")
    """Each squared value is within delta below that of the matrix, and not above it."""
    states = stored(sketch(rows, Spec("fd", 16)), "states")
    exact = X.thin_svd(rows).select("k", F.col("sigma").alias("exact"))
    delta = states.first()["delta"]
    part = X.low_rank_sketch(states, 8).join(exact, "k")
    square, true = F.col("sigma") * F.col("sigma"), F.col("exact") * F.col("exact")
    return part.select("k", square.between(true * (1 - 1e-9) - delta, true * (1 + 1e-9)).alias("agrees"))


@query(
    "projection_matrix",
    f"WITH {_A} SELECT 8.0::DOUBLE AS trace, CAST(m * m AS BIGINT) AS cells, 8.0::DOUBLE AS sq_norm, true AS as_product FROM a",
)
def projection_matrix(spark, sf):
    """A projector of rank k has trace k and squared norm k, and equals V'V as a product of entry tables."""
    rows = embeddings(spark, sf, "float")
    svd = stored(X.spectrum(sketch(rows, Spec("fd", 16))), "svd")
    p = X.projection_matrix(svd, 8)
    i, j = np.indices(p.shape)
    cells = spark.createDataFrame(pa.table({"i": i.ravel(), "j": j.ravel().astype(np.int32), "v": p.ravel()}))
    v = svd.filter("k < 8").select(F.col("k").cast("bigint").alias("i"), F.posexplode("v").alias("j", "v"))
    vt = v.select(F.col("j").cast("bigint").alias("i"), F.col("i").cast("int").alias("j"), "v")
    product = matmul(vt, v).select("i", "j", F.col("v").alias("w"))
    return cells.join(product, ["i", "j"], "full").agg(
        rounded(F.sum(F.when(F.col("i") == F.col("j"), F.col("v")))).alias("trace"),
        F.count("v").alias("cells"),
        rounded(F.sum(F.col("v") * F.col("v"))).alias("sq_norm"),
        F.every(F.coalesce(F.abs(F.col("v") - F.col("w")) < 1e-9, F.lit(False))).alias("as_product"),
    )


@query("project_rows", f"WITH {_A} SELECT CAST(n AS BIGINT) AS n, true AS shorter, true AS reduced_agrees FROM a, t")
def project_rows(spark, sf):
    rows = embeddings(spark, sf, "float")
    v = X.leading_vectors(X.spectrum(sketch(rows, Spec("fd", 16))), 8)
    square = F.aggregate("vec", F.lit(0.0), lambda t, x: t + x * x)
    total = R.sq_frobenius(rows).scalar()
    inside = X.project_rows(rows, v).agg(F.count("*").alias("n"), F.sum(square).alias("s"))
    short = X.project_rows(rows, v, reduced=True).agg(F.sum(square)).scalar()
    return inside.select(
        "n", (F.col("s") <= total).alias("shorter"), (F.abs(F.col("s") / short - 1) < 1e-9).alias("reduced_agrees")
    )


@query(
    "projection_error",
    f"WITH {_A} SELECT CAST(8 AS INTEGER) AS k, true AS at_least_one, true AS below_two FROM t",
)
def projection_error(spark, sf):
    scored = R.sketch_and_score(embeddings(spark, sf, "float"), Spec("fd", 16))
    return scored.select(
        "k", (F.col("proj_err") >= 1 - 1e-9).alias("at_least_one"), (F.col("proj_err") < 2).alias("below_two")
    )


@query(
    "tail_energy",
    f"WITH {_A} SELECT {sql_rounded('s', 4)} AS whole, 0.0::DOUBLE AS none, true AS between FROM t",
)
def tail_energy(spark, sf):
    svd = X.thin_svd(embeddings(spark, sf, "float"))
    some = X.tail_energy(svd, 8).scalar()
    none = X.tail_energy(svd, 64).scalar()
    return X.tail_energy(svd, 0).select(
        rounded("tail", 4).alias("whole"),
        rounded(none, 4).alias("none"),
        ((some > 0) & (some < F.col("tail"))).alias("between"),
    )


@query(
    "fd_bounds",
    f"WITH {_A} SELECT l, {sql_rounded('2.0 * s / l')} AS bound, true AS rank_bound_smaller FROM t, (SELECT unnest([16, 32, 48]) AS l)",
)
def fd_bounds(spark, sf):
    rows = embeddings(spark, sf, "float")
    tail = X.tail_energy(X.thin_svd(rows), 8).scalar()
    sizes = F.explode(F.array(F.lit(16), F.lit(32), F.lit(48))).alias("l")
    bound = R.fd_bound(F.col("sq_norm"), F.col("l"))
    return R.sq_frobenius(rows).select("sq_norm", sizes).select(
        "l", rounded(bound).alias("bound"), (R.fd_rank_bound(tail, F.col("l"), 8) < bound).alias("rank_bound_smaller")
    )


@query(
    "errors_close",
    f"WITH {_A} SELECT true AS close FROM t",
)
def errors_close(spark, sf):
    """Two sketches of the same size differ in error by a ratio within 0.1 of one."""
    from ..operators.algebra import ratio_close

    specs = [Spec("batch_fd", 16, b=20, grid_id=0), Spec("batch_fd", 16, b=20, svd="lapack", grid_id=1)]
    scored = R.sketch_and_score(embeddings(spark, sf, "float"), specs)
    return scored.agg(F.min("err").alias("a"), F.max("err").alias("b")).select(
        ratio_close(F.col("a"), F.col("b")).alias("close")
    )


@query("rows_as_entries_gram", f"SELECT {sql_rounded('s', 4)} AS trace FROM {EMB_MASS}")
def rows_as_entries_gram(spark, sf):
    """Trace of the Gram matrix through the entry layout equals the squared norm."""
    cells = X.gram_of_entries(rows_to_entries(embeddings(spark, sf)), 64)
    return cells.agg(rounded(F.sum(F.when(F.col("i") == F.col("j"), F.col("v"))), 4).alias("trace"))
