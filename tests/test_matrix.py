"""Algebra, spectra, sources and clustering against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallgram import layouts as L
from tallgram import sources as S
from tallgram.functions import fourwise_sign, gaussian_hash, pairwise_bucket, random_bucket, random_sign, uniform_hash
from tallgram.operators import algebra as A
from tallgram.operators import checks as C
from tallgram.operators import clustering as K
from tallgram.operators import errors as R
from tallgram.operators import spectra as X
from tests.conftest import dense, dense_entries


def test_column_and_array_hashes_agree(spark):
    ids = np.array([0, 1, 5, 2**31 - 1, 2**40 + 3, -7])
    df = spark.createDataFrame([(int(x),) for x in ids], "x bigint")
    x = F.col("x")
    got = df.select(
        "x", pairwise_bucket(x, 7).alias("b"), fourwise_sign(x).alias("s"), uniform_hash(x, F.lit(3), 5).alias("u"),
        gaussian_hash(x, 2, 1).alias("g"), random_sign(x, 1).alias("rs"), random_bucket(x, 9, 1).alias("rb"),
    ).toPandas().set_index("x").loc[ids]
    assert (got.b == pairwise_bucket(ids, 7)).all() and (got.s == fourwise_sign(ids)).all()
    assert (got.u == uniform_hash(ids, 3, 5)).all()
    np.testing.assert_allclose(got.g, gaussian_hash(ids, 2, 1), rtol=1e-12)
    assert (got.rs == random_sign(ids, 1)).all() and (got.rb == random_bucket(ids, 9, 1)).all()


def test_hash_quality():
    n = np.arange(20000)
    u = uniform_hash(n, 1, 4)
    assert abs(u.mean() - 0.5) < 0.01 and abs(np.corrcoef(u[:-1], u[1:])[0, 1]) < 0.03
    g = gaussian_hash(n, 0, 2)
    assert abs(g.mean()) < 0.03 and abs(g.std() - 1) < 0.03
    s = fourwise_sign(n)
    assert abs(s.mean()) < 0.05 and abs((s[:-1] * s[1:]).mean()) < 0.05


def test_layout_round_trip(spark, to_rows, to_entries, rng):
    a = rng.standard_normal((9, 7)) * (rng.random((9, 7)) < 0.4)
    a[4] = 0
    entries = L.rows_to_entries(to_rows(a))
    np.testing.assert_array_equal(dense_entries(entries, a.shape), a)
    ids = spark.range(9).withColumnRenamed("id", "row_id")
    np.testing.assert_array_equal(dense(L.entries_to_rows(entries, 7, ids)), a)
    sparse = L.entries_to_sparse_rows(entries)
    np.testing.assert_array_equal(dense_entries(L.sparse_rows_to_entries(sparse), a.shape), a)
    np.testing.assert_array_equal(dense_entries(L.transpose(entries), a.T.shape), a.T)
    assert {r.row_id for r in A.zero_rows(ids, entries).collect()} == set(np.flatnonzero(~a.any(1)))


def test_products_and_sums(to_rows, to_entries, rng):
    a, b = rng.standard_normal((12, 5)), rng.standard_normal((5, 6))
    np.testing.assert_allclose(dense_entries(A.matmul(to_entries(a), to_entries(b)), (12, 6)), a @ b)
    np.testing.assert_allclose(dense(A.matmul_small(to_rows(a), b)), a @ b)
    c = rng.standard_normal((12, 5))
    np.testing.assert_allclose(dense_entries(A.mat_sub(to_entries(a), to_entries(c)), a.shape), a - c)
    with pytest.raises(ValueError, match="shapes"):
        A.mat_add(to_entries(a), to_entries(b), ((12, 5), (12, 6)))
    assert A.approx_equal(to_entries(a), to_entries(a + 1e-6)).first().equal
    assert not A.approx_equal(to_entries(a), to_entries(c)).first().equal
    np.testing.assert_allclose(dense(A.vstack(to_rows(a), to_rows(c))), np.vstack([a, c]))


def test_matmul_with_a_hot_inner_index(spark):
    left = spark.range(600).select(F.col("id").alias("i"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).cast("int").alias("j"), F.lit(1.0).alias("v"))
    right = spark.range(7).select("id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("j")).select(F.col("id").alias("i"), "j", (F.col("id") + F.col("j")).cast("double").alias("v"))
    got = A.matmul(left, right).agg(F.count("*").alias("n"), F.sum("v").alias("s")).first()
    j = np.where(np.arange(600) % 3 == 0, 0, np.arange(600) % 7)
    assert got.n == 2400 and got.s == sum(4 * x + 6 for x in j)


def test_spectra(to_rows, to_entries, rng):
    a = rng.standard_normal((70, 9)) * np.linspace(0.1, 4, 9)
    rows, sigma = to_rows(a), np.linalg.svd(a)[1]
    svd = X.thin_svd(rows)
    got, v = X.small_svd(svd)
    np.testing.assert_allclose(got, sigma)
    u = dense(X.left_vectors(rows, svd))
    np.testing.assert_allclose((u * got) @ v, a, atol=1e-9)
    r = X.small_svd(X.randomized_svd(rows, 4, 9))[0]
    np.testing.assert_allclose(r, sigma[:4], rtol=1e-6)
    assert R.spectral_norm_wide(rows, 9) == pytest.approx(sigma[0] ** 2)
    assert X.tail_energy(svd, 3).first().tail == pytest.approx((sigma[3:] ** 2).sum())
    p = X.projection_matrix(svd, 3)
    np.testing.assert_allclose(p @ p, p, atol=1e-10)
    np.testing.assert_allclose(dense(X.project_rows(rows, X.leading_vectors(svd, 3))), a @ p, atol=1e-9)
    np.testing.assert_allclose(dense_entries(X.gram_of_entries(to_entries(a), 9), (9, 9)), a.T @ a)
    thin = np.zeros((2500, 300))
    thin[np.arange(2500), np.arange(2500) % 300] = np.arange(2500)
    thin[np.arange(2500), (np.arange(2500) * 7) % 300] += 1
    np.testing.assert_allclose(dense_entries(X.gram_of_entries(to_entries(thin), 300), (300, 300)), thin.T @ thin)


def test_rank_deficient_projector(to_rows, rng):
    a = rng.standard_normal((40, 2)) @ rng.standard_normal((2, 8))
    p = X.projection_matrix(X.thin_svd(to_rows(a)), 5)
    assert np.trace(p) == pytest.approx(2.0)
    np.testing.assert_allclose(a @ p, a, atol=1e-8)


def test_validation(spark, to_rows):
    assert C.validate_matrix(to_rows(np.ones((5, 3))), l=3) == (5, 3)
    for kwargs in (dict(l=4), dict(l=3, strict=True)):
        with pytest.raises(ValueError):
            C.validate_matrix(to_rows(np.ones((5, 3))), **kwargs)
    for vec in ([1.0], [1.0, None], [1.0, float("nan")], None):
        bad = spark.createDataFrame([(0, [1.0, 2.0]), (1, vec)], "row_id bigint, vec array<double>")
        with pytest.raises(ValueError):
            C.validate_matrix(bad)
    with pytest.raises(ValueError):
        C.validate_parallel(3, 4)


def test_validation_of_sparse_layouts(spark):
    rows = "row_id bigint, idx array<int>, val array<double>"
    good = [(0, [0, 2], [1.0, 2.0]), (1, [], [])]
    assert C.validate_matrix(spark.createDataFrame(good, rows), l=2, m=3) == (2, 3)
    faults = [(5, None, [1.0]), (5, [1], None), (5, [1, 2], [1.0]), (5, [1], [float("nan")]), (5, [1], [None]), (5, [3], [1.0]), (5, [-1], [1.0]), (5, [1, 1], [1.0, 2.0]), (5, [None], [1.0])]
    for fault in faults:
        with pytest.raises(ValueError, match="not a sound matrix"):
            C.validate_matrix(spark.createDataFrame([*good, fault], rows), m=3)
    cells = "i bigint, j int, v double"
    good = [(0, 0, 1.0), (0, 2, 2.0), (7, 1, 1.0)]
    assert C.validate_matrix(spark.createDataFrame(good, cells), m=3) == (2, 3)
    for fault in [(None, 1, 1.0), (1, None, 1.0), (1, 1, None), (1, 1, float("inf")), (1, 3, 1.0), (1, -1, 1.0), (0, 0, 5.0)]:
        with pytest.raises(ValueError, match="not a sound matrix"):
            C.validate_matrix(spark.createDataFrame([*good, fault], cells), m=3)
    with pytest.raises(ValueError, match="number of columns"):
        C.validate_matrix(spark.createDataFrame(good, cells))
    with pytest.raises(ValueError, match="no rows"):
        C.validate_matrix(spark.createDataFrame([], cells), m=3)
    with pytest.raises(ValueError, match="does not fit"):
        C.validate_matrix(spark.createDataFrame(good, cells), l=3, m=3)


def test_dense_text_of_many_splits(spark, to_rows, rng, tmp_path):
    a = np.round(rng.standard_normal((500, 3)), 4)
    S.write_dense_text(to_rows(a, 5), str(tmp_path / "m"))
    assert S.text_shape(spark, str(tmp_path / "m")) == (500, 3)
    one = tmp_path / "one.txt"
    one.write_text("# 500 3\n" + "\n".join(" ".join(f"{x:.4f}" for x in r) for r in a) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = S.read_dense_text(spark, str(one), check_header=True)
        assert got.rdd.getNumPartitions() > 1
        np.testing.assert_array_equal(dense(got), a)
        np.testing.assert_array_equal(dense(S.read_dense_text(spark, str(tmp_path / "m"), True)), a)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    wrong = tmp_path / "wrong.txt"
    wrong.write_text("# 3 2\n1 2\n3 4\n")
    with pytest.raises(ValueError, match="header"):
        S.read_dense_text(spark, str(wrong), check_header=True)


@pytest.mark.parametrize(
    "symmetry,expected",
    [("general", [[1, 0], [5, 2]]), ("symmetric", [[1, 5], [5, 2]]), ("skew-symmetric", [[1, -5], [5, 2]])],
)
def test_matrix_market(spark, tmp_path, symmetry, expected):
    path = tmp_path / "a.mtx"
    path.write_text(f"%%MatrixMarket matrix coordinate real {symmetry}\n% note\n2 2 3\n1 1 1\n2 1 5\n2 2 2\n")
    np.testing.assert_array_equal(dense_entries(S.read_matrix_market(spark, str(path)), (2, 2)), expected)
    path.write_text("%%MatrixMarket matrix array real general\n1 1\n1\n")
    with pytest.raises(ValueError):
        S.read_matrix_market(spark, str(path))


def test_numbered_and_buckets(spark):
    ids = spark.range(1000).select((F.col("id") * 3).alias("x")).repartition(6)
    ranks = {r.x: r["rank"] for r in A.numbered(ids, "x").collect()}
    assert ranks == {3 * n: n for n in range(1000)}
    starts = A.bucket_starts(ids, "x", 4)
    assert starts == [0, 750, 1500, 2250]
    sizes = A.bucketize(ids, "x", starts).groupBy("bucket").count().collect()
    assert sorted((r.bucket, r["count"]) for r in sizes) == [(n, 250) for n in range(4)]


def test_generators(spark):
    ids = spark.range(50).withColumnRenamed("id", "row_id")
    one = dense(S.uniform_matrix(ids, 6, 1))
    two = dense(S.uniform_matrix(ids.repartition(7), 6, 1))
    np.testing.assert_array_equal(one, two)
    assert 0 < one.min() and one.max() < 1 and len(np.unique(one)) == 300
    sparse = dense_entries(S.sparse_uniform(ids, 40, 0.1, 2), (50, 40))
    assert 0.05 < (sparse > 0).mean() < 0.15
    np.testing.assert_array_equal(dense(S.index_matrix(ids, 3)), np.arange(150).reshape(50, 3))
    np.testing.assert_array_equal(dense_entries(S.identity_matrix(ids), (50, 50)), np.eye(50))


def test_kmeans(spark, to_rows, rng):
    a = np.vstack([rng.standard_normal((40, 5)) + 8 * c for c in range(3)])
    rows = to_rows(a)
    start = spark.createDataFrame([(c, [float(x) for x in a[40 * c]]) for c in range(3)], K.CENTERS)
    centers = K.lloyd(rows, start, 5)
    _, points = K.centers_array(centers)
    expected = np.array([a[40 * c : 40 * c + 40].mean(0) for c in range(3)])
    np.testing.assert_allclose(points, expected, atol=1e-9)
    cost = sum(((a[40 * c : 40 * c + 40] - expected[c]) ** 2).sum() for c in range(3))
    assert K.kmeans_cost_nearest(rows, centers).first().cost == pytest.approx(cost)
    labelled = K.nearest_centroid(rows, centers, keep_vec=True)
    assert K.kmeans_cost(labelled, centers).first().cost == pytest.approx(cost)
    got = K.cost_from_labels(labelled).first()
    assert got.cost == pytest.approx(cost) and got.k == 3
    trained, _, _ = K.kmeans_train(rows, 3, seed=2)
    assert trained == pytest.approx(cost, rel=1e-6)


def test_ties_go_to_the_lowest_label(spark, to_rows):
    rows = to_rows(np.array([[0.0, 0.0], [1.0, 1.0]]))
    centers = spark.createDataFrame([(3, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0])], K.CENTERS)
    assert {r.label for r in K.nearest_centroid(rows, centers).collect()} == {1}


def test_empty_cluster_stays(spark, to_rows):
    rows = to_rows(np.array([[0.0], [1.0]]))
    start = spark.createDataFrame([(0, [0.5]), (1, [100.0])], K.CENTERS)
    assert K.centers_array(K.lloyd(rows, start, 3))[1].tolist() == [[0.5], [100.0]]


def test_generated_cells_are_hashed_once(spark):
    """As Catalyst expressions the powers of the hash repeat it, thousands of operations a cell."""
    ids = spark.sql("SELECT CAST(id AS INT) * 5 - 20 AS row_id FROM range(30) UNION ALL SELECT NULL UNION ALL SELECT 5")
    sparse, full = S.sparse_uniform(ids, 70, 0.1, 2), S.uniform_matrix(ids, 6, 2)
    for made in (sparse, full):
        assert len(made._jdf.queryExecution().optimizedPlan().toString()) < 5000
    assert [f.dataType.simpleString() for f in sparse.schema] == ["int", "int", "double"]
    known = sorted([*range(-20, 130, 5), 5])
    expected = [(i, j, float(uniform_hash(i, j, 3))) for i in known for j in range(70) if uniform_hash(i, j, 2) < 0.1]
    assert sorted(map(tuple, sparse.collect())) == sorted(expected)
    got = [(r.row_id, r.vec) for r in full.collect()]
    assert [vec for i, vec in got if i is None] == [[None] * 6]
    assert sorted(r for r in got if r[0] is not None) == [(i, [float(uniform_hash(i, j, 2)) for j in range(6)]) for i in known]
