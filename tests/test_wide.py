"""Grids of sketches of wide matrices, triangular factors, cached spectra, balanced ranges, centre grids."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallgram.layouts import entries_to_sparse_rows
from tallgram.operators import clustering as K
from tallgram.operators import errors as R
from tallgram.operators import spectra as X
from tallgram.operators.algebra import bucketize, matmul_small
from tallgram.operators.cache import cached_spectrum, fingerprint
from tallgram.operators.kernels import Spec
from tallgram.operators.linear import count_sketch
from tallgram.operators.ranges import WeightedQuantiles, balanced_starts
from tallgram.operators.sketch import sketch, state_entries
from tallgram.plans.sweeps import sweep_partitions, sweep_sketch_compare
from tests.conftest import dense_entries

GRID = [
    Spec("sparse_batch_pfd", 6, b=6, alpha=0.5), Spec("sparse_batch_pfd", 10, b=10, alpha=0.5, grid_id=1),
    Spec("sparse_rand_batch_pfd", 6, b=8, alpha=0.5, grid_id=2), Spec("cw", 12, grid_id=3), Spec("jlt", 12, grid_id=4),
]


def sparse_matrix(rng, n=90, m=70):
    return rng.standard_normal((n, m)) * (rng.random((n, m)) < 0.3) * np.linspace(3, 0.1, m)


def test_a_grid_scored_without_a_gram_matrix(spark, to_entries, rng):
    a = sparse_matrix(rng)
    sparse = entries_to_sparse_rows(to_entries(a)).cache()
    exact = {r.grid_id: r for r in R.sketch_and_score(sparse, GRID, m=70, k=3).collect()}
    states = sketch(sparse, GRID, m=70).cache()
    wide = {r.grid_id: r for r in R.score_wide(sparse, states, 70, k=3).collect()}
    assert wide.keys() == exact.keys()
    for g, row in wide.items():
        assert row.abs_err == pytest.approx(exact[g].abs_err, rel=1e-5)
        assert row.sq_norm == pytest.approx((a**2).sum()) and row.sketch_mass == pytest.approx(exact[g].sketch_mass)
        assert row.proj_err == pytest.approx(exact[g].proj_err, rel=1e-2)
        assert row.certified and exact[g].certified and row.kind == exact[g].kind and row.delta == exact[g].delta


def test_a_grid_takes_no_more_passes_than_its_slowest_member(spark, to_entries, rng):
    a = sparse_matrix(rng, 120, 90)
    sparse = entries_to_sparse_rows(to_entries(a)).cache()
    sketches = {n: rng.standard_normal((4, 90)) * n for n in range(3)} | {9: None}
    alone = {g: R.norms_wide(sparse, 90, {g: b}, block=3) for g, b in sketches.items()}
    together, passes = R.norms_wide(sparse, 90, sketches, block=3)
    assert passes <= max(p for _, p in alone.values())
    for g, b in sketches.items():
        true = np.abs(np.linalg.eigvalsh(a.T @ a - (0 if b is None else b.T @ b))).max()
        assert together[g] == pytest.approx(true, rel=1e-5) and alone[g][0][g] == pytest.approx(true, rel=1e-5)


def test_empty_sketches_of_wide_matrices_fail(spark, to_entries, rng):
    sparse = entries_to_sparse_rows(to_entries(sparse_matrix(rng))).cache()
    states = sketch(sparse, GRID, m=70)
    empty = states.withColumn("data", F.expr("transform(data, x -> 0D)"))
    assert not any(r.certified for r in R.score_wide(sparse, empty, 70).collect())


def test_sweeps_above_the_matrix_budget(spark, to_entries, rng):
    a = sparse_matrix(rng, 60, 400)
    sparse = entries_to_sparse_rows(to_entries(a)).cache()
    spark.conf.set("spark.tallgram.matrix.bytes", "700000")  # below 8 m^2
    try:
        got = sweep_partitions(sparse, 6, 0.5, 6, [2, 3], m=400).collect()
    finally:
        spark.conf.unset("spark.tallgram.matrix.bytes")
    assert sorted((r.variant, r.partitions) for r in got) == [("exact", 2), ("exact", 3), ("randomized", 2), ("randomized", 3)]
    assert all(r.certified and r.time_s > 0 for r in got)


def test_count_sketch_states_equal_the_aggregation(spark, to_rows, to_entries, rng):
    a = sparse_matrix(rng)
    expected = dense_entries(count_sketch(to_rows(a), 8), (8, 70))
    for matrix, m in ((to_rows(a), None), (entries_to_sparse_rows(to_entries(a)), 70)):
        got = dense_entries(state_entries(sketch(matrix, Spec("cw", 8), m=m)), (8, 70))
        np.testing.assert_allclose(got, expected, atol=1e-9)


def test_all_kinds_of_a_comparison_share_one_scan(spark, to_rows, rng, tmp_path):
    to_rows(rng.standard_normal((400, 24)) * np.linspace(3, 0.1, 24)).write.parquet(str(tmp_path / "m"))
    results = sweep_sketch_compare(spark.read.parquet(str(tmp_path / "m")), [8, 16], 24, b=8)
    assert {(r.variant, r.param_value) for r in results.collect() if r.certified} >= {(v, l) for v in ("fd", "pfd", "batch-pfd", "rand-batch-pfd", "jlt", "cw") for l in (8.0, 16.0)}
    final = results._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("FileScan") == 1


def test_triangular_factors_keep_small_values(spark, to_rows, rng):
    a = rng.standard_normal((200, 12)) * 10.0 ** np.linspace(0, -10, 12)
    rows = to_rows(a, 7)
    svd = X.thin_svd(rows, 12, method="qr")
    sigma, v = X.small_svd(svd)
    lengths = np.array([r.vec for r in matmul_small(rows, v.T).collect()])
    np.testing.assert_allclose(np.sqrt((lengths**2).sum(0)), sigma, rtol=1e-6)
    np.testing.assert_allclose(v @ v.T, np.eye(12), atol=1e-9)
    assert (np.diff(sigma) <= 0).all()
    # values over nine decades in no particular directions: what a Gram matrix loses
    u, w = np.linalg.qr(rng.standard_normal((200, 12)))[0], np.linalg.qr(rng.standard_normal((12, 12)))[0]
    true = 10.0 ** np.linspace(0, -9, 12)
    rows = to_rows(u * true @ w, 7)
    np.testing.assert_allclose(X.small_svd(X.thin_svd(rows, 12, method="qr"))[0], true, rtol=1e-5)
    assert abs(X.small_svd(X.thin_svd(rows, 12))[0][-1] / true[-1] - 1) > 1e-2
    few = X.thin_svd(to_rows(a[:5], 2), 12, method="qr")
    np.testing.assert_allclose(X.small_svd(few)[0], np.linalg.svd(a[:5], compute_uv=False), rtol=1e-6)
    with pytest.raises(ValueError, match="unknown method"):
        X.thin_svd(rows, 12, method="other")


def test_spectra_are_kept_by_content(spark, to_rows, rng, tmp_path):
    a = rng.standard_normal((60, 5))
    rows, folder = to_rows(a, 3), str(tmp_path / "kept")
    first, hit = cached_spectrum(rows, folder)
    assert not hit
    again, hit = cached_spectrum(to_rows(a, 7).orderBy(F.desc("row_id")), folder)
    assert hit and sorted(map(str, again.collect())) == sorted(map(str, first.collect()))
    for other in (a[:-1], np.vstack([a, a[-1:]]), a + np.eye(60, 5)):
        svd, hit = cached_spectrum(to_rows(other), folder)
        assert not hit
        np.testing.assert_allclose(X.small_svd(svd)[0], np.linalg.svd(other, compute_uv=False))
    assert fingerprint(rows) != fingerprint(rows.withColumn("vec", F.col("vec").cast("array<float>")))
    assert not cached_spectrum(rows, folder, method="qr")[1]
    # a writer that stopped halfway leaves nothing that is read
    os.makedirs(f"{folder}/_draft-x")
    assert cached_spectrum(rows, folder)[1]


def test_ranges_hold_equally_much(spark, rng):
    ids = np.sort(rng.choice(10**9, 4000, replace=False))
    weights = np.where(np.arange(4000) < 400, 200.0, 1.0) * rng.integers(1, 4, 4000)
    df = spark.createDataFrame([(int(i), float(w)) for i, w in zip(ids, weights)], "row_id long, w double").repartition(9)
    starts = balanced_starts(df, F.col("w"), 8, size=512)
    assert len(starts) == 8
    sums = [r.s for r in bucketize(df, "row_id", starts).groupBy("bucket").agg(F.sum("w").alias("s")).collect()]
    share = weights.sum() / 8
    assert len(sums) == 8 and max(abs(s - share) for s in sums) < 0.1 * share
    # one id that outweighs all others has a range of its own
    heavy = balanced_starts(df.unionByName(spark.createDataFrame([(int(ids[2000]) + 0, 10.0**9)], df.schema)), F.col("w"), 4)
    assert int(ids[2000]) in heavy
    assert balanced_starts(df.limit(0), F.col("w"), 4) == []


def test_summaries_keep_their_bound():
    rng = np.random.default_rng(4)
    whole = WeightedQuantiles(100)
    ids, weights = rng.integers(0, 10**6, 50_000), rng.random(50_000)
    for at in range(0, 50_000, 500):
        whole.add(ids[at : at + 500], weights[at : at + 500])
    whole.cut()
    assert len(whole.ids) <= 210 and whole.weights.sum() == pytest.approx(weights.sum())
    for start in whole.starts(10)[1:]:
        below = weights[ids < start].sum() / weights.sum()
        assert min(abs(below - k / 10) for k in range(1, 10)) < 0.05


def test_rows_in_ranges_give_the_same_certificate(spark, to_entries, rng):
    sparse = entries_to_sparse_rows(to_entries(sparse_matrix(rng))).cache()
    for starts in ([0], [0, 30, 60], [10, 20]):
        row = R.sketch_and_score(sparse, Spec("sparse_batch_pfd", 6, b=6), m=70, starts=starts).first()
        assert row.certified and row.n_rows == sparse.filter(F.size("idx") > 0).count()


def test_centre_grids_in_shared_scans(spark, to_rows, rng):
    a = np.vstack([rng.standard_normal((60, 6)) * 0.2 + 5 * rng.standard_normal(6) for _ in range(5)])
    rows = to_rows(a)
    grid = {k: a[rng.choice(len(a), k, replace=False)] for k in (2, 5)}
    for k, total in K.grid_sums(rows, grid).items():
        d = ((a[:, None, :] - grid[k][None]) ** 2).sum(-1)
        near = d.argmin(1)
        np.testing.assert_allclose(total[:, 6], np.bincount(near, minlength=k))
        np.testing.assert_allclose(total[:, -1].sum(), d.min(1).sum())
        np.testing.assert_allclose(total[:, :6], [a[near == c].sum(0) for c in range(k)], atol=1e-9)
    together = K.lloyd_grid(rows, grid, 4)
    for k in grid:
        np.testing.assert_allclose(together[k], K.lloyd_grid(rows, {k: grid[k]}, 4)[k])
    cost, centers, labelled = K.kmeans_train(rows, 5, seed=3)
    best = sum(((a[60 * c : 60 * c + 60] - a[60 * c : 60 * c + 60].mean(0)) ** 2).sum() for c in range(5))
    assert cost == pytest.approx(best, rel=1e-6) and K.kmeans_cost(labelled, centers).first().cost == pytest.approx(cost)
    got = {r.k: r for r in K.kmeans_on_sketch(rows, 4, [2, 5], seed=1).collect()}
    assert all(0 < r.full_cost <= r.sketch_cost * (1 + 1e-9) for r in got.values())
    assert got[5].full_cost == pytest.approx(best, rel=1e-3)
    assert len(K.seeds(to_rows(np.ones((6, 3))), [4])[4]) == 1


def test_centres_over_the_budget_are_not_fetched(spark):
    spark.conf.set("spark.tallgram.matrix.bytes", "1000")
    try:
        wide = spark.range(20).selectExpr("cast(id as int) AS label", "array_repeat(1D, 10) AS center")
        with pytest.raises(ValueError, match="the centres"):
            K.centers_array(wide)
    finally:
        spark.conf.unset("spark.tallgram.matrix.bytes")


def test_reproducible_split_is_dealt_to_more_tasks_as_rows_grow(spark, monkeypatch):
    """Four buckets of any number of rows were read by four tasks."""
    import tallgram.operators.sketch as S

    rows = spark.range(3000).select(
        F.col("id").alias("row_id"), F.array(*[1 + F.sin(F.col("id") * (k + 1)) for k in range(6)]).alias("vec")
    )
    spec = Spec("batch_pfd", 3, b=20, alpha=0.5)
    assert S.split_pieces(rows, 4, 2) == 1
    monkeypatch.setattr(S, "PIECE_BYTES", 16 << 10)
    pieces = S.split_pieces(rows, 4, 2)
    assert pieces == 8  # 288,000 bytes in parts of 16 KiB
    states = S.partial_states(rows, [spec], buckets=4, pieces=pieces).select("part", "n_rows").collect()
    assert sorted(r.part for r in states) == list(range(32)) and max(r.n_rows for r in states) < 200
    one, two = (R.sketch_and_score(x, spec, buckets=4, fan_in=2).first() for x in (rows, rows.repartition(7)))
    assert one == two and one.n_rows == 3000 and one.certified


def test_counted_rows_add_up_rows_of_one_id(spark, monkeypatch):
    """Counted where they are read and sent packed: no exchange of single entries."""
    import tallgram.layouts as layouts

    monkeypatch.setattr(layouts, "COUNTED", 4)
    lists = spark.createDataFrame(
        [(1, [5, 2, 5]), (2, [7]), (1, [2, 9, 9, 9, 0]), (None, [3]), (4, [1, 1, 1, 1, 1, 1])], "row_id bigint, idx array<int>"
    )
    made = layouts.counted_rows(lists.repartition(3))
    got = {r.row_id: (r.idx, r.val) for r in made.collect()}
    assert got == {
        1: ([0, 2, 5, 9], [1.0, 2.0, 2.0, 3.0]), 2: ([7], [1.0]), None: ([3], [1.0]), 4: ([1], [6.0]),
    }
    assert "Generate" not in made._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("kind", ["sparse_batch_pfd", "sparse_rand_batch_pfd"])
def test_a_pool_of_sparse_rows_writes_the_sketch_once(rng, monkeypatch, kind):
    from tallgram.operators import kernels as K

    a = rng.integers(1, 9, (1000, 60)) * (rng.random((1000, 60)) < 0.15) * 1.0
    a[500:520] = 0.0
    i, j = np.nonzero(a)
    sizes = np.bincount(i, minlength=len(a))

    def sketched():
        acc = K.accumulator(K.Spec(kind, 6, b=5, alpha=0.5), 60)
        for low in range(0, 1000, 300):
            mine = (i >= low) & (i < low + 300)
            acc.add_sparse(sizes[low : low + 300], j[mine], a[i, j][mine])
        return acc.state(True)

    writes, plain = [], K.SparseBlock.add_transposed
    monkeypatch.setattr(K.SparseBlock, "add_transposed", lambda self, w, out: (writes.append(1), plain(self, w, out)))
    pooled = sketched()
    assert len(writes) <= 6  # and not once for each of about 100 shrinks
    monkeypatch.setattr(K, "POOL_ROWS", 0)  # a shrink at a time
    each = sketched()
    assert pooled["n_rows"] == each["n_rows"] == np.count_nonzero(sizes)
    np.testing.assert_allclose([pooled[n] for n in ("delta", "mass_lost")], [each[n] for n in ("delta", "mass_lost")], rtol=1e-9)
    b, c = (s["data"].reshape(-1, 60) for s in (pooled, each))
    np.testing.assert_allclose(b.T @ b, c.T @ c, atol=1e-8 * (a * a).sum())
    if kind == "sparse_batch_pfd":
        dense = K.accumulator(K.Spec("batch_pfd", 6, b=5, alpha=0.5), 60)
        dense.add(a[sizes > 0])
        dense = dense.state(True)
        np.testing.assert_allclose(pooled["delta"], dense["delta"], rtol=1e-9)
        d = dense["data"].reshape(-1, 60)
        np.testing.assert_allclose(b.T @ b, d.T @ d, atol=1e-8 * (a * a).sum())


@pytest.mark.parametrize("share", [0.02, 0.9])
def test_sparse_block_products(rng, share):
    from tallgram.operators.kernels import SparseBlock

    a = rng.standard_normal((40, 90)) * (rng.random((40, 90)) < share)
    a[7] = 0.0
    i, j = np.nonzero(a)
    block = SparseBlock([(np.r_[i, i], np.r_[j, j], np.r_[a[i, j], a[i, j]])], 40, 90)  # equal cells add up
    x, w = rng.standard_normal((90, 33)), rng.standard_normal((40, 5))
    np.testing.assert_allclose(block.times(x), 2 * a @ x, atol=1e-12)
    np.testing.assert_allclose(block.gram(16), 4 * a @ a.T, atol=1e-11)
    for out in (np.ones((5, 90)), np.asfortranarray(np.ones((5, 90)))):
        block.add_transposed(w, out)
        np.testing.assert_allclose(out, 1 + 2 * w.T @ a, atol=1e-12)


def test_words_are_hashed_once_a_batch():
    import hashlib

    import pyarrow as pa

    from tallgram.workload.sketches import WIDE, hashed_words

    texts = ["", None, " a\n\nb a ", "\n", "\tb\r é", "a"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8), pa.int64()), pa.array(["x", "y z", *texts])], ["row_id", "text"])
    (got,) = hashed_words([batch.slice(2)])
    words = [[], [], ["a", "b", "a"], [], ["\tb\r", "é"], ["a"]]
    expected = [[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % WIDE for w in ws] for ws in words]
    assert got.column("idx").to_pylist() == expected and got.column("row_id").to_pylist() == list(range(2, 8))
