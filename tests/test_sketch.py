"""Distributed sketches: splits, merges, keys, change points, bad input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallgram.api import sketch_matrix
from tallgram.layouts import entries_to_sparse_rows
from tallgram.operators import errors as R
from tallgram.operators import sketch as S
from tallgram.operators.kernels import Spec
from tallgram.operators.linear import count_sketch, gaussian_sketch
from tallgram.sources import load_sketches, save_sketches
from tests.conftest import cov_err, dense_entries, sketch_of


def certified(a, row):
    b = sketch_of(row)
    total = (a**2).sum()
    assert len(b) <= row["l"]
    assert (b**2).sum() + row["mass_lost"] == pytest.approx(total, rel=1e-9)
    limit = row["mass_lost"] if "rand" in row["kind"] else row["delta"]
    assert cov_err(a, b) <= limit + 1e-9 * total


@pytest.mark.parametrize("partitions,fan_in", [(1, 64), (7, 2), (16, 3)])
def test_any_split_keeps_the_certificate(to_rows, rng, partitions, fan_in):
    a = rng.standard_normal((300, 14))
    row = S.sketch(to_rows(a, partitions), Spec("batch_pfd", 6, b=8, alpha=0.5), fan_in=fan_in).first()
    assert row["n_rows"] == 300
    certified(a, row)


def test_buckets_do_not_depend_on_the_input_partitions(to_rows, rng):
    a = rng.standard_normal((200, 8))
    spec = Spec("batch_fd", 4, b=6)
    results = [S.sketch(to_rows(a, p), spec, buckets=5, fan_in=2).first() for p in (1, 2, 7)]
    assert len({r["delta"] for r in results}) == 1
    assert all(list(r["data"]) == list(results[0]["data"]) for r in results)


def test_float_input_and_empty_partitions(to_rows, rng):
    a = rng.standard_normal((20, 6)).astype(np.float32)
    rows = to_rows(a, 40).withColumn("vec", F.col("vec").cast("array<float>"))
    certified(a.astype(float), S.sketch(rows, Spec("fd", 3)).first())


def test_hot_key_and_evicted_states(to_rows, rng, monkeypatch):
    a = rng.standard_normal((400, 5))
    key = np.where(np.arange(400) % 3 == 0, 0, np.arange(400) % 50)
    rows = to_rows(a, 6).withColumn("k", F.when(F.col("row_id") % 3 == 0, 0).otherwise(F.col("row_id") % 50))
    monkeypatch.setattr(S, "LIVE_BYTES", 2000)
    got = {r["key"]: r for r in S.sketch(rows, Spec("batch_fd", 2, b=3), key="k").collect()}
    assert len(got) == 50
    for k, r in got.items():
        certified(a[key == int(k)], r)
        assert r["n_rows"] == (key == int(k)).sum()


@pytest.mark.parametrize("t", [1, 2, 7, 16, 17, 23, 31, 45, 59])
def test_change_point_never_loses_mass(to_rows, rng, t):
    a = rng.standard_normal((60, 13))
    spec = Spec("dynamic_fd", 4, b=12, l2=12, change_at=t)
    state = S.sketch(to_rows(a, 3), spec)
    row = S.realised_size(state, 4, 12).first()
    assert row["l"] == 12
    certified(a, row)
    assert 4 <= row["l_hat"] <= 12


def test_change_point_beyond_the_end(to_rows, rng):
    with pytest.raises(Exception, match="change point"):
        S.sketch(to_rows(rng.random((10, 20))), Spec("dynamic_fd", 2, b=9, l2=4, change_at=10)).collect()


def test_update_and_saved_state(spark, to_rows, rng, tmp_path):
    a = rng.standard_normal((120, 9))
    rows = to_rows(a)
    spec = Spec("batch_pfd", 4, b=5, alpha=0.5)
    save_sketches(S.sketch(rows.filter("row_id < 50"), spec), str(tmp_path / "s"), "d")
    loaded = load_sketches(spark, str(tmp_path / "s"), "d", "batch_pfd", 4)
    row = S.update_sketch(loaded, rows.filter("row_id >= 50"), S.spec_of(loaded.first())).first()
    assert row["n_rows"] == 120
    certified(a, row)


def test_too_few_rows(to_rows, rng):
    with pytest.raises(Exception, match="exceeds"):
        S.sketch(to_rows(rng.random((3, 9))), Spec("fd", 5)).collect()
    with pytest.raises(Exception, match="exceeds"):
        S.sketch(to_rows(rng.random((30, 4))), Spec("fd", 5)).collect()


@pytest.mark.parametrize(
    "vec,message", [([1.0, None], "null"), ([1.0, float("nan")], "NaN"), ([1.0], "ragged|width"), (None, "null")]
)
def test_bad_vectors(spark, vec, message):
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (1, vec)], "row_id bigint, vec array<double>").coalesce(1)
    with pytest.raises(Exception, match=message):
        S.sketch(rows, Spec("gram")).collect()


def test_scores_match_numpy(to_rows, rng):
    a = rng.standard_normal((150, 10)) * np.linspace(0.2, 2, 10)
    specs = [Spec("batch_fd", 6, b=7, grid_id=0), Spec("jlt", 6, grid_id=1)]
    rows = to_rows(a, 1)
    states = {r["grid_id"]: sketch_of(r) for r in S.sketch(rows, specs).collect()}
    for r in R.sketch_and_score(rows, specs, k=3).collect():
        b = states[r["grid_id"]]
        assert r["abs_err"] == pytest.approx(cov_err(a, b))
        assert r["err"] == pytest.approx(cov_err(a, b) / (a**2).sum())
        v = np.linalg.svd(b)[2][:3]
        sigma = np.linalg.svd(a)[1]
        outside = ((a - a @ v.T @ v) ** 2).sum()
        assert r["proj_err"] == pytest.approx(outside / (sigma[3:] ** 2).sum())


def test_wide_sparse_and_spectral_norm(to_entries, rng):
    a = rng.standard_normal((60, 900)) * (rng.random((60, 900)) < 0.01)
    sparse = entries_to_sparse_rows(to_entries(a)).repartition(3)
    row = S.sketch(sparse, Spec("sparse_rand_batch_pfd", 6, b=10, alpha=0.5), m=900).first()
    certified(a, row)
    b = sketch_of(row)
    assert R.spectral_norm_wide(sparse, 900) == pytest.approx(np.linalg.norm(a, 2) ** 2, rel=1e-4)
    assert R.spectral_norm_wide(sparse, 900, b) == pytest.approx(cov_err(a, b), rel=1e-3)


def test_state_budget(to_entries, rng):
    sparse = entries_to_sparse_rows(to_entries(np.eye(3)))
    with pytest.raises(ValueError, match="budget"):
        S.sketch(sparse, Spec("sparse_batch_pfd", 2000), m=10_000_000)


def test_state_layouts(to_rows, rng):
    a = rng.standard_normal((40, 6))
    state = S.sketch(to_rows(a, 1), Spec("fd", 3))
    b = sketch_of(state.first())
    np.testing.assert_allclose(dense_entries(S.state_entries(state), b.shape), b)
    rows = sorted(S.state_rows(state).collect(), key=lambda r: r.row_id)
    np.testing.assert_allclose([list(r.vec) for r in rows], b)


def test_identity_count_sketch(to_rows):
    got = dense_entries(count_sketch(to_rows(np.eye(20)), 10), (10, 20))
    assert (np.abs(got).sum(axis=0) == 1).all()


@pytest.mark.parametrize("hashing", ["pairwise", "random"])
def test_linear_sketches_on_positive_data(to_rows, rng, hashing):
    a = rng.random((400, 12))
    total = (a**2).sum()
    b = dense_entries(count_sketch(to_rows(a), 64, hashing), (64, 12))
    assert cov_err(a, b) < 0.8 * total
    b = dense_entries(gaussian_sketch(to_rows(a), 64), (64, 12))
    assert cov_err(a, b) < 0.8 * total


def test_sparse_and_dense_gaussian_agree(to_rows, to_entries, rng):
    a = rng.standard_normal((30, 8)) * (rng.random((30, 8)) < 0.5)
    one = dense_entries(gaussian_sketch(to_rows(a), 5), (5, 8))
    two = dense_entries(gaussian_sketch(entries_to_sparse_rows(to_entries(a)), 5, m=8), (5, 8))
    np.testing.assert_allclose(one, two, atol=1e-12)


def test_result_object(spark, to_rows, rng, tmp_path):
    a = rng.standard_normal((90, 8))
    result = sketch_matrix(to_rows(a, 1), "batch_pfd", 4, b=5, alpha=0.5)
    b = dense_entries(result.entries(), (4, 8))
    assert result.cov_error() == pytest.approx(cov_err(a, b) / (a**2).sum())
    assert result.projection_error(2) >= 1 - 1e-9
    assert result.spectrum().count() == len(sketch_of(result.state().first()))
    result.save(str(tmp_path / "s"), "d")
    more = result.update(to_rows(a, 1))
    assert more.state().first()["n_rows"] == 180
    with pytest.raises(ValueError, match="unknown sketch"):
        sketch_matrix(to_rows(a, 1), "nope", 4)


def test_rank_bound_needs_more_rows():
    with pytest.raises(ValueError):
        R.fd_rank_bound(1.0, 4, 4)
