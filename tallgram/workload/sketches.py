"""The sketch family. Each query reports the mass identity |B|^2 + lost = |A|^2 and whether the
covariance error stays within what the sketch certifies."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from ..api import SketchResult, sketch_matrix
from ..layouts import counted_rows, entries_to_sparse_rows, rows_to_entries
from ..operators.algebra import bucketize, row_slice
from ..operators.errors import score, sketch_and_score
from ..operators.kernels import Spec
from ..operators.linear import count_sketch, gaussian_sketch
from ..operators.ranges import balanced_sparse_starts
from ..operators.sketch import realised_size, sketch, update_sketch
from ..operators.spectra import gram_state
from ..session import map_arrow, stored
from .registry import (
    ACCOUNT_MASS, ACCOUNTS, EMB, EMB_MASS, HOURS, LINE_MASS, LINES, account_entries, embeddings,
    entries_out, line_matrix, query, rounded, sql_bucket, sql_gaussian, sql_rounded, sql_sign, table,
)

RANDOMIZED = ("rand_batch_pfd", "sparse_rand_batch_pfd")


def certificate(scored, digits: int = 4, extra=()):
    """(l, m, mass, err_le_delta); a randomized shrink certifies the lost mass instead of delta."""
    limit = F.when(F.col("kind").isin(*RANDOMIZED), F.col("mass_lost")).otherwise(F.col("delta"))
    return scored.select(
        *extra,
        "l",
        "m",
        rounded(F.col("sketch_mass") + F.col("mass_lost"), digits).alias("mass"),
        ((F.col("abs_err") <= limit + 1e-9 * F.col("sq_norm")) & F.col("certified")).alias("err_le_delta"),
    )


def _sql(l: int, m: str, mass: str, digits: int = 4) -> str:
    return (
        f"SELECT CAST({l} AS INTEGER) AS l, CAST({m} AS INTEGER) AS m, {sql_rounded('s', digits)} AS mass, "
        f"true AS err_le_delta FROM {mass}"
    )


_EMB_M = "(SELECT max(len(embedding)) FROM embeddings)"


def _on_embeddings(name: str, spec: Spec, l: int | None = None):
    @query(name, _sql(l or spec.l, _EMB_M, EMB_MASS))
    def run(spark, sf):
        return certificate(sketch_and_score(embeddings(spark, sf, "float"), spec))

    return run


batch_pfd = _on_embeddings("batch_pfd", Spec("batch_pfd", 16, b=40, alpha=0.2))
_on_embeddings("fd", Spec("fd", 16))
_on_embeddings("fd_median", Spec("fd_median", 16))
_on_embeddings("batch_fd", Spec("batch_fd", 16, b=40))
_on_embeddings("fast_fd", Spec("fast_fd", 16))
_on_embeddings("pfd", Spec("pfd", 16, alpha=0.2))
_on_embeddings("tweak_pfd_fast", Spec("tweak_fast", 16, alpha=0.4))
_on_embeddings("tweak_pfd_slow", Spec("tweak_slow", 16, alpha=0.4))
_on_embeddings("rand_batch_pfd", Spec("rand_batch_pfd", 16, b=40, alpha=0.2))
_on_embeddings("batch_fd_lapack", Spec("batch_fd", 16, b=40, svd="lapack"))
_on_embeddings("batch_fd_randomized", Spec("rand_batch_pfd", 16, b=40))


def _on_lines(name: str, spec: Spec):
    @query(name, _sql(spec.l, "4", LINE_MASS))
    def run(spark, sf):
        return certificate(sketch_and_score(line_matrix(spark, sf), spec))


_on_lines("batch_fd_lines", Spec("batch_fd", 2, b=200))
_on_lines("batch_pfd_lines", Spec("batch_pfd", 2, b=200, alpha=0.5))


def _on_accounts(name: str, spec: Spec):
    @query(name, _sql(spec.l, str(HOURS), ACCOUNT_MASS))
    def run(spark, sf):
        sparse = entries_to_sparse_rows(account_entries(spark, sf), summed=True)
        return certificate(sketch_and_score(sparse, spec, m=HOURS))


_on_accounts("sparse_batch_pfd", Spec("sparse_batch_pfd", 8, b=32, alpha=0.2))
_on_accounts("sparse_rand_batch_pfd", Spec("sparse_rand_batch_pfd", 8, b=32, alpha=0.2))


@query(
    "dynamic_fd",
    f"SELECT CAST(32 AS INTEGER) AS l, CAST({_EMB_M} AS INTEGER) AS m, {sql_rounded('s', 4)} AS mass, true AS err_le_delta, true AS l_hat_between FROM {EMB_MASS}",
)
def dynamic_fd(spark, sf):
    spec = Spec("dynamic_fd", 16, b=40, l2=32, change_at=200)
    scored = realised_size(sketch_and_score(embeddings(spark, sf, "float"), spec), 16, 32)
    between = ((F.col("l_hat") >= 16) & (F.col("l_hat") <= 32)).alias("l_hat_between")
    return certificate(scored.withColumn("kind", F.lit("dynamic_fd"))).join(
        scored.select("l", between), "l"
    )


@query(
    "update_sketch",
    f"SELECT CAST(16 AS INTEGER) AS l, count(*) AS n_rows, {sql_rounded('max(s)', 4)} AS mass, true AS err_le_delta FROM embeddings, {EMB_MASS}",
)
def update_sketch_query(spark, sf):
    """Sketch the first rows, then go on with the rest."""
    rows = embeddings(spark, sf, "float")
    spec = Spec("batch_pfd", 16, b=40, alpha=0.2)
    first = sketch(row_slice(rows, 0, 249), spec)
    state = update_sketch(first, rows.filter("row_id >= 250"), spec)
    return certificate(score(state, gram_state(rows))).select(
        "l", F.lit(None).cast("bigint").alias("n"), "mass", "err_le_delta"
    ).join(state.select("l", "n_rows"), "l").select("l", "n_rows", "mass", "err_le_delta")


@query(
    "parallel_batch_pfd",
    f"SELECT parts, CAST(2 AS INTEGER) AS l, {sql_rounded('s', 4)} AS mass, true AS err_le_delta FROM {LINE_MASS}, (SELECT unnest([4, 8]) AS parts)",
)
def parallel_batch_pfd(spark, sf):
    """Rows split into a fixed number of buckets, merged pairwise."""
    out = None
    for parts in (4, 8):
        spec = Spec("batch_pfd", 2, b=100, alpha=0.5)
        scored = sketch_and_score(line_matrix(spark, sf), spec, buckets=parts, fan_in=2)
        part = certificate(scored).select(F.lit(parts).alias("parts"), "l", "mass", "err_le_delta")
        out = part if out is None else out.unionByName(part)
    return out


@query("sparse_parallel_batch_pfd", _sql(8, str(HOURS), ACCOUNT_MASS))
def sparse_parallel_batch_pfd(spark, sf):
    """Rows split into ranges of ids with equally many entries, merged pairwise."""
    sparse = stored(entries_to_sparse_rows(account_entries(spark, sf), summed=True), "sparse")
    spec = Spec("sparse_batch_pfd", 8, b=8, alpha=0.2)
    return certificate(sketch_and_score(sparse, spec, m=HOURS, starts=balanced_sparse_starts(sparse, 6), fan_in=2))


@query(
    "sketch_keyed",
    f"SELECT CAST(l_returnflag AS VARCHAR) AS key, CAST(2 AS INTEGER) AS l, count(*) AS n_rows, {sql_rounded('sum(l_quantity / 50 * l_quantity / 50 + l_discount * 10 * l_discount * 10 + l_tax * 10 * l_tax * 10)', 4)} AS mass, true AS err_le_delta FROM lineitem GROUP BY l_returnflag",
)
def sketch_keyed(spark, sf):
    """One sketch per key in a single pass; each task keeps one state per key."""
    lines = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"),
        F.array(F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 10).alias("vec"),
        "l_returnflag",
    )
    scored = sketch_and_score(lines, Spec("batch_fd", 2, b=100), key="l_returnflag")
    return scored.select("key", "n_rows", *certificate_columns()).select(
        "key", "l", "n_rows", "mass", "err_le_delta"
    )


def certificate_columns():
    return [
        "l",
        rounded(F.col("sketch_mass") + F.col("mass_lost"), 4).alias("mass"),
        ((F.col("abs_err") <= F.col("delta") + 1e-9 * F.col("sq_norm")) & F.col("certified")).alias("err_le_delta"),
    ]


WIDE = 50_000
_WORDS = (
    "(SELECT doc_id AS i, CAST(('0x' || substr(md5(w), 1, 8))::BIGINT % 50000 AS INTEGER) AS j, count(*) AS v "
    "FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \\n]+')) AS w FROM documents) WHERE w <> '' GROUP BY ALL)"
)


def word_rows(spark, sf):
    """Stored sparse rows of word counts, one a document, hashed to WIDE columns."""
    documents = table(spark, sf, "documents").select(F.col("doc_id").cast("long").alias("row_id"), "text")
    lists = map_arrow(documents, hashed_words, "row_id bigint, idx array<int>").filter("size(idx) > 0")
    return stored(counted_rows(lists), "words")


def hashed_words(batches):
    """Column numbers of the words of each text; a word is hashed once a batch."""
    for batch in batches:
        texts = batch.column("text").fill_null("")
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        words = lists.flatten().dictionary_encode()
        column = [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % WIDE if w else -1 for w in words.dictionary.to_pylist()]
        idx = np.array(column, dtype=np.int32)[words.indices.to_numpy()]
        keep = idx >= 0
        ends = np.concatenate([[0], np.cumsum(keep)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        idx = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(idx[keep]))
        yield pa.RecordBatch.from_arrays([batch.column("row_id"), idx], ["row_id", "idx"])


@query(
    "wide_sparse_grid",
    f"SELECT kind, CAST(l AS INTEGER) AS l, CAST({WIDE} AS INTEGER) AS m, {sql_rounded('CAST(s AS DOUBLE)', 2)} AS mass, true AS certified, true AS projection_fits "
    f"FROM (SELECT sum(v * v) AS s FROM {_WORDS}), (SELECT unnest(['sparse_batch_pfd', 'sparse_batch_pfd', 'sparse_rand_batch_pfd', 'cw']) AS kind, unnest([16, 24, 16, 64]) AS l)",
)
def wide_sparse_grid(spark, sf):
    """Four sketches of a matrix that allows no m x m matrix: one pass for them, and shared passes for all
    their errors."""
    specs = [
        Spec("sparse_batch_pfd", 16, b=16, alpha=0.5), Spec("sparse_batch_pfd", 24, b=24, alpha=0.5, grid_id=1),
        Spec("sparse_rand_batch_pfd", 16, b=32, alpha=0.5, grid_id=2), Spec("cw", 64, grid_id=3),
    ]
    scored = sketch_and_score(word_rows(spark, sf), specs, m=WIDE, k=4)
    mass = F.when(F.col("kind") == "cw", F.col("sq_norm")).otherwise(F.col("sketch_mass") + F.col("mass_lost"))
    return scored.select(
        "kind", "l", "m", rounded(mass, 2).alias("mass"), "certified", F.col("proj_err").between(1 - 1e-6, 4).alias("projection_fits")
    )


@query(
    "balanced_ranges",
    f"SELECT CAST(6 AS BIGINT) AS parts, CAST(sum(n) AS BIGINT) AS entries, true AS balanced FROM (SELECT i, count(DISTINCT j) AS n FROM {_WORDS} GROUP BY i)",
)
def balanced_ranges(spark, sf):
    """Entries of each range of documents: within a tenth of the mean, besides what one document holds."""
    sparse = word_rows(spark, sf).withColumn("n", F.size("idx"))
    dealt = bucketize(sparse, "row_id", balanced_sparse_starts(sparse, 6))
    parts = dealt.groupBy("bucket").agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    mean = F.sum("n") / F.count("*")
    return parts.agg(
        F.count("*").alias("parts"), F.sum("n").alias("entries"),
        ((F.max("n") <= 1.1 * mean + F.max("most")) & (F.min("n") >= 0.9 * mean - F.max("most"))).alias("balanced"),
    )


@query(
    "wide_sparse_errors",
    f"SELECT CAST({WIDE} AS INTEGER) AS m, {sql_rounded('CAST(sum(v * v) AS DOUBLE)', 2)} AS mass, true AS err_fits, true AS projection_fits FROM {_WORDS}",
)
def wide_sparse_errors(spark, sf):
    """Word counts hashed to a width that allows no m x m matrix; both errors without one."""
    sparse = word_rows(spark, sf)
    result = sketch_matrix(sparse, "auto_pfd", 16, m=WIDE, b=16, alpha=0.5)
    state = stored(result.state(), "state")
    result = SketchResult(sparse, result.spec, WIDE, state)
    worst, outside = result.cov_error(normalized=False), result.projection_error(k=4)
    kept = F.aggregate("data", F.lit(0.0), lambda t, x: t + x * x)
    return state.select(
        "m", rounded(kept + F.col("mass_lost"), 2).alias("mass"),
        (F.lit(worst) <= F.col("delta") * (1 + 1e-6)).alias("err_fits"), F.lit(1 - 1e-9 <= outside < 4).alias("projection_fits"),
    )


@query(
    "object_api",
    f"SELECT CAST(16 AS INTEGER) AS l, CAST({_EMB_M} AS BIGINT) AS directions, {sql_rounded('s', 4)} AS mass, true AS err_fits, true AS projection_fits FROM {EMB_MASS}",
)
def object_api(spark, sf):
    """One call per matrix: state, entries, spectrum and errors from the result object."""
    result = sketch_matrix(embeddings(spark, sf, "float"), "batch_pfd", 16, b=40, alpha=0.2)
    err, outside = result.cov_error(normalized=False), result.projection_error(k=4)
    columns = result.entries().agg(F.countDistinct("j")).first()[0]
    top = result.spectrum().agg(F.max("sigma")).first()[0]
    kept = F.aggregate("data", F.lit(0.0), lambda t, x: t + x * x)
    return result.state().select(
        "l", F.lit(columns).cast("bigint").alias("directions"), rounded(kept + F.col("mass_lost"), 4).alias("mass"),
        (F.lit(err) <= F.col("delta") * (1 + 1e-9)).alias("err_fits"), F.lit(top > 0 and 1 - 1e-9 <= outside < 4).alias("projection_fits"),
    )


@query(
    "sketch_registry",
    f"SELECT kind, CAST(16 AS INTEGER) AS l, CAST({_EMB_M} AS INTEGER) AS m, {sql_rounded('s', 4)} AS mass, true AS certified FROM {EMB_MASS}, (SELECT unnest(['fd', 'fast_fd', 'batch_fd', 'fd_median', 'pfd', 'batch_pfd', 'rand_batch_pfd', 'tweak_fast', 'tweak_slow', 'dynamic_fd', 'jlt', 'cw', 'sparse_batch_pfd', 'sparse_rand_batch_pfd']) AS kind)",
)
def sketch_registry(spark, sf):
    """Every kind by name: the dense ones from one pass, the sparse ones from another. Linear kinds keep the
    mass but for the deviation that ``certified`` allows; their row shows that of the matrix."""
    kinds = (
        "fd", "fast_fd", "batch_fd", "fd_median", "pfd", "batch_pfd", "rand_batch_pfd", "tweak_fast",
        "tweak_slow", "jlt", "cw",
    )
    rows = embeddings(spark, sf, "float")
    specs = [Spec(kind, 16, b=20, alpha=0.4, grid_id=n) for n, kind in enumerate(kinds)]
    specs.append(Spec("dynamic_fd", 16, b=20, l2=16, change_at=50, grid_id=len(kinds)))
    sparse = stored(entries_to_sparse_rows(rows_to_entries(embeddings(spark, sf))), "sparse")
    some = [Spec(kind, 16, b=20, alpha=0.4, grid_id=n) for n, kind in enumerate(("sparse_batch_pfd", "sparse_rand_batch_pfd"))]
    m = rows.select(F.size("vec").alias("m")).first().m
    scored = sketch_and_score(rows, specs).unionByName(sketch_and_score(sparse, some, m=m))
    linear = F.col("kind").isin("jlt", "cw")
    mass = F.when(linear, F.col("sq_norm")).otherwise(F.col("sketch_mass") + F.col("mass_lost"))
    return scored.select("kind", "l", "m", rounded(mass, 4).alias("mass"), "certified")


@query(
    "dynamic_fd_keyed",
    f"SELECT CASE WHEN i < 100 THEN 'early' ELSE CAST(label % 2 AS VARCHAR) END AS key, count(DISTINCT i) AS n_rows, {sql_rounded('sum(v * v)', 4)} AS mass, true AS err_le_delta FROM {EMB} GROUP BY 1",
)
def dynamic_fd_keyed(spark, sf):
    """Keys before, around and after the change point; one lies wholly before it."""
    key = F.when(F.col("vec_id") < 100, "early").otherwise((F.col("label") % 2).cast("string"))
    rows = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<float>").alias("vec"), key.alias("key")
    )
    scored = sketch_and_score(rows, Spec("dynamic_fd", 16, b=40, l2=32, change_at=200), key="key")
    return certificate(scored, extra=["key", "n_rows"]).select("key", "n_rows", "mass", "err_le_delta")


_LINE_CELLS = (
    f"(SELECT i, CAST(generate_subscripts([c0, c1, c2, c3], 1) - 1 AS INTEGER) AS j, unnest([c0, c1, c2, c3]) AS v FROM {LINES})"
)


def _cw_sql(source: str, l: int, digits: int = 6) -> str:
    value = sql_rounded(f"sum({sql_sign('i')} * v)", digits)
    return f"SELECT {sql_bucket('i', l)} AS i, j, {value} AS v FROM {source} t GROUP BY {sql_bucket('i', l)}, j"


@query("cw_sparse", _cw_sql(EMB, 16))
def cw_sparse(spark, sf):
    return entries_out(count_sketch(embeddings(spark, sf), 16))


@query("cw_sparse_lines", _cw_sql(_LINE_CELLS, 64))
def cw_sparse_lines(spark, sf):
    return entries_out(count_sketch(line_matrix(spark, sf), 64))


@query("cw_sparse_entries", _cw_sql(ACCOUNTS, 32))
def cw_sparse_entries(spark, sf):
    return entries_out(count_sketch(account_entries(spark, sf), 32))


@query(
    "jlt_gaussian",
    f"SELECT CAST(r AS BIGINT) AS i, j, {sql_rounded('sum(g * v) / sqrt(16.0)')} AS v FROM {EMB} e JOIN (SELECT vec_id, r, {sql_gaussian('vec_id', 'r', 5)} AS g FROM embeddings, (SELECT unnest(range(16)) AS r)) d ON d.vec_id = e.i GROUP BY ALL",
)
def jlt_gaussian(spark, sf):
    return entries_out(gaussian_sketch(embeddings(spark, sf, "float"), 16, seed=5))


@query(
    "jlt_gaussian_sparse",
    f"SELECT CAST(d.r AS BIGINT) AS i, e.j AS j, {sql_rounded('sum(g * v) / sqrt(8.0)')} AS v FROM {ACCOUNTS} e JOIN (SELECT user_id, r, {sql_gaussian('user_id', 'r', 5)} AS g FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest(range(8)) AS r)) d ON d.user_id = e.i GROUP BY ALL",
)
def jlt_gaussian_sparse(spark, sf):
    sparse = entries_to_sparse_rows(account_entries(spark, sf), summed=True)
    return entries_out(gaussian_sketch(sparse, 8, m=HOURS, seed=5)).filter("v <> 0")
