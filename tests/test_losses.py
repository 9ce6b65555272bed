"""Inputs that must not get lost, and bad ones that must not pass unnoticed."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallgram.functions.hashing import PRIME, fourwise_sign, gaussian_hash, pairwise_bucket
from tallgram.layouts import transpose
from tallgram.operators import clustering as C
from tallgram.operators.errors import sq_frobenius
from tallgram.operators.kernels import Spec, merger
from tallgram.operators.linear import count_sketch
from tallgram.operators.sketch import realised_size, sketch
from tallgram.plans.sweeps import sweep_changepoint
from tallgram.session import fits_broadcast, lookup, table_bytes
from tallgram.sources.tables import pivot_to_sparse
from tests.conftest import cov_err, sketch_of


def keyed(spark, a, keys, partitions=3):
    rows = [(i, [float(x) for x in v], k) for i, (v, k) in enumerate(zip(a, keys))]
    return spark.createDataFrame(rows, "row_id bigint, vec array<double>, k string").repartition(partitions)


def test_dynamic_keys_on_one_side_of_the_change(spark, rng):
    a = rng.standard_normal((90, 8))
    keys = ["a" if i < 20 else "b" if i % 2 else "c" for i in range(90)]
    spec = Spec("dynamic_fd", 3, b=8, l2=6, change_at=30)
    states = sketch(keyed(spark, a, keys), spec, key="k")
    got = {r["key"]: r for r in states.collect()}
    assert set(got) == {"a", "b", "c"}
    for k, row in got.items():
        own = a[[x == k for x in keys]]
        b = sketch_of(row)
        assert row["n_rows"] == len(own)
        assert (b**2).sum() + row["mass_lost"] == pytest.approx((own**2).sum())
        assert cov_err(own, b) <= row["delta"] + 1e-9
        assert row["delta_first"] <= row["delta"]
    assert got["a"]["l"] == 3 and got["b"]["l"] == 6
    sizes = {r["key"]: r["l_hat"] for r in realised_size(states, 3, 6).collect()}
    assert sizes["a"] == 3 and 3 <= sizes["b"] <= 6


def test_dynamic_grid_points_beyond_the_end(spark, rng):
    a = rng.standard_normal((40, 6))
    rows = keyed(spark, a, ["x"] * 40).drop("k")
    specs = [Spec("dynamic_fd", 3, b=6, l2=5, change_at=t, grid_id=n) for n, t in enumerate((10, 500, 20))]
    with pytest.raises(Exception, match="change point"):
        sketch(rows, specs).collect()
    assert {r["grid_id"] for r in sketch(rows, specs, strict=False).collect()} == {0, 1, 2}
    with pytest.raises(Exception, match="change point"):
        sweep_changepoint(rows, 3, 5, 6, [10, 40]).collect()


def test_labels_without_a_centre_raise(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0], 0), (1, [3.0, 4.0], 7)], "row_id bigint, vec array<double>, label int")
    centers = spark.createDataFrame([(0, [1.0, 1.0])], C.CENTERS)
    with pytest.raises(Exception, match="no centre for label 7"):
        C.kmeans_cost(rows, centers).collect()
    assert C.kmeans_cost(rows.filter("label = 0"), centers).first().cost == 1.0


def test_null_elements_raise(spark):
    rows = spark.createDataFrame([(0, [1.0, None], 0), (1, [3.0, 4.0], 0)], "row_id bigint, vec array<double>, label int")
    centers = spark.createDataFrame([(0, [1.0, 1.0])], C.CENTERS)
    for result in (C.kmeans_cost(rows, centers), C.compute_centers(rows), C.cost_from_labels(rows), sq_frobenius(rows), count_sketch(rows, 4)):
        with pytest.raises(Exception, match="NULL"):
            result.collect()


def test_null_categories_are_kept(spark):
    facts = spark.createDataFrame([(1, "a", 2.0), (1, None, 3.0), (2, None, 4.0), (2, "b", 5.0)], "r long, c string, v double")
    got = sorted(tuple(x) for x in pivot_to_sparse(facts, "r", "c", "v").collect())
    assert got == [(1, 0, 3.0), (1, 1, 2.0), (2, 0, 4.0), (2, 2, 5.0)]


@pytest.mark.parametrize("kind", ["sparse_batch_pfd", "jlt", "gram"])
@pytest.mark.parametrize("idx", [[7], [-1], [0, 1], [None]])
def test_column_numbers_outside_the_matrix_raise(spark, kind, idx):
    rows = spark.createDataFrame([(0, [0, 2], [1.0, 1.0]), (1, idx, [1.0])], "row_id bigint, idx array<int>, val array<double>")
    with pytest.raises(Exception, match="column numbers"):
        sketch(rows, Spec(kind, 2, b=2), m=5, strict=False).collect()


def test_ids_a_prime_apart_have_hashes_of_their_own(spark):
    ids = np.arange(2000, dtype=np.int64)
    for far in (ids + PRIME, ids + 3 * PRIME, ids - PRIME):
        assert 0.4 < (fourwise_sign(ids) == fourwise_sign(far)).mean() < 0.6
        assert (pairwise_bucket(ids, 64) == pairwise_bucket(far, 64)).mean() < 0.1
        assert not np.isclose(gaussian_hash(ids, 0), gaussian_hash(far, 0)).any()
    values = [5, 5 + PRIME, 5 - PRIME, 2**62, -(2**62)]
    df = spark.createDataFrame([(v,) for v in values], "x long").select(fourwise_sign(F.col("x")).alias("s"), pairwise_bucket(F.col("x"), 64).alias("b"))
    assert [tuple(r) for r in df.collect()] == list(zip(fourwise_sign(np.array(values)).tolist(), pairwise_bucket(np.array(values), 64).tolist()))


def test_row_ids_that_no_column_number_holds(spark):
    entries = spark.createDataFrame([(2**31, 0, 1.0)], "i long, j int, v double")
    with pytest.raises(Exception, match="beyond INT"):
        transpose(entries).collect()


def test_lookups_are_measured_in_bytes(spark):
    few_wide = spark.createDataFrame([("x" * 100_000,)] * 20, "s string")
    many_narrow = spark.range(10_000)
    assert table_bytes(few_wide) > 2_000_000 > table_bytes(many_narrow)
    assert not fits_broadcast(few_wide, 1_000_000) and fits_broadcast(many_narrow, 1_000_000)
    plan = lambda t: many_narrow.join(t.withColumnRenamed("s", "id"), "id")._jdf.queryExecution().toString()
    assert "strategy=broadcast" in plan(lookup(few_wide, "a")) and "strategy=broadcast" not in plan(lookup(few_wide, "b", 1_000_000))


@pytest.mark.parametrize("kind", ["fd_median", "tweak_fast", "tweak_slow"])
def test_merges_shrink_once_per_state(rng, kind):
    spec = Spec(kind, 8, alpha=0.4)
    acc = merger(spec, 12)
    for _ in range(20):
        block = rng.standard_normal((8, 12))
        acc.merge(dict(n_rows=8, delta=0.0, delta_first=0.0, mass_lost=0.0, data=block.ravel()))
    assert acc.shrinks <= 4 * 20


def test_wide_errors_agree_with_the_gram_matrix(spark, to_entries, rng):
    from tallgram.api import SketchResult, sketch_matrix
    from tallgram.layouts import entries_to_sparse_rows

    a = rng.standard_normal((80, 60)) * (rng.random((80, 60)) < 0.3) * np.linspace(3, 0.1, 60)
    sparse = entries_to_sparse_rows(to_entries(a)).cache()
    result = sketch_matrix(sparse, "auto_pfd", 6, m=60, b=6, alpha=0.5)
    assert result.spec.kind == "sparse_batch_pfd" and not result.wide
    exact = result.cov_error(), result.projection_error(k=3)
    spark.conf.set("spark.tallgram.matrix.bytes", "28000")  # below 8 m^2, and the Krylov basis starts again
    try:
        wide = SketchResult(sparse, result.spec, 60, result.state())
        assert wide.wide
        from tallgram.operators.errors import spectral_norm_wide
        from tallgram.operators.sketch import single

        b = single(wide.state())[1].reshape(-1, 60)
        norm = spectral_norm_wide(sparse, 60, b, block=6, passes=80)
        outside = wide.projection_error(k=3)
    finally:
        spark.conf.unset("spark.tallgram.matrix.bytes")
    assert norm / (a**2).sum() == pytest.approx(exact[0], rel=1e-4)
    assert outside == pytest.approx(exact[1], rel=1e-3)


def test_a_second_save_replaces_the_first(spark, to_rows, rng, tmp_path):
    from tallgram.sources import load_sketches, save_sketches

    states = sketch(to_rows(rng.standard_normal((30, 6))), Spec("fd", 3))
    for _ in range(2):
        save_sketches(states, str(tmp_path / "s"), "one")
    save_sketches(states, str(tmp_path / "s"), "two")
    assert load_sketches(spark, str(tmp_path / "s")).count() == 2
