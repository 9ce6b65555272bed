import numpy as np
from pyspark.sql import functions as F

from tallgram.llm import multiindex as X


def brute(rows, cosine=0.95):
    ok = [v is not None and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v) for _, v in rows]
    a = np.array([np.array(v, float) / np.linalg.norm(v) if k else np.zeros(16) for (_, v), k in zip(rows, ok)])
    linked = a @ a.T >= cosine
    np.fill_diagonal(linked, False)
    least = np.array([i for i, _ in rows])
    while True:
        fresh = np.minimum(least, np.where(linked, least[None, :], 10**9).min(axis=1))
        if (fresh == least).all():
            break
        least = fresh
    return sorted((i, int(n), int(c), i == c) for (i, _), n, c in zip(rows, linked.sum(1), least))


def rows_of(n=400, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    while len(rows) < n:
        base = rng.normal(size=16)
        for _ in range(int(rng.choice([1, 1, 2, 5, 30]))):
            rows.append((base + rng.normal(size=16) * rng.choice([0, 0.05, 0.15, 0.25])).astype(np.float32).tolist())
    ids = rng.permutation(len(rows)).tolist()
    return list(zip(ids, rows))


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)


def result(df):
    return sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect())


ODD = [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] + [1.0] * 15), (9004, [None] + [1.0] * 15), (9005, [1.0] * 3), (9006, []), (9007, [float("inf")] * 16), (9008, [1e30] * 16), (9009, [1e-30] * 16)]


def test_small_tables_are_exact(spark):
    rows = rows_of() + ODD
    assert result(X.clusters(frame(spark, rows))) == brute(rows)


def test_blocks_and_copies(spark, monkeypatch):
    monkeypatch.setattr(X, "BLOCK", 16)
    monkeypatch.setattr(X, "TRACT", 40)
    monkeypatch.setattr(X, "VECTOR_ROWS", 7)
    monkeypatch.setattr(X, "CELL", 20)
    rows = rows_of(300, 2)
    rows += [(5000 + i, rows[0][1]) for i in range(90)] + [(6000, (2 * np.array(rows[0][1])).tolist())]
    assert result(X.clusters(frame(spark, rows), recall=0.9999)) == brute(rows)


def test_recall(spark, monkeypatch):
    monkeypatch.setattr(X, "CELL", 10)
    rows = rows_of(3000, 3)
    found = {i: n for i, n, _, _ in result(X.clusters(frame(spark, rows)))}
    expected = {i: n for i, n, _, _ in brute(rows)}
    assert all(found[i] <= n for i, n in expected.items())
    assert sum(found.values()) >= 0.99 * sum(expected.values())


def test_traversal_visits_the_nearest_cells():
    rng = np.random.default_rng(4)
    sample = rng.normal(size=(500, 16))
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    grid = X.Grid(sample, 20_000, 0.95, 0.99)
    first, second = grid.distances(sample)
    sums = (first[:, :, None] + second[:, None, :]).reshape(len(sample), -1)
    for row, cells in zip(sums, grid.nearest(sample)):
        assert len(set(cells.tolist())) == grid.visits
        assert np.allclose(np.sort(row[cells]), np.sort(row)[: grid.visits])


def test_visits_by_tract():
    rng = np.random.default_rng(9)
    sample = rng.normal(size=(400, 8))
    grid = X.Grid(sample / np.linalg.norm(sample, axis=1, keepdims=True), 50_000, 0.9, 0.9)
    grid.range, grid.ranges = 3, -(-grid.k // 3)
    own, cells = grid.cells(sample), grid.nearest(sample)
    for o, row, got in zip(own, cells, X.visits_of(grid, own, cells).to_pylist()):
        expected = sorted({int(o), *(int(c) for c in row if c > o)})
        assert [c for v in got for c in v["cells"]] == expected
        assert [v["tract"] for v in got] == sorted({int(grid.tract(np.array(c))) for c in expected})
        assert all((grid.tract(np.array(v["cells"])) == v["tract"]).all() for v in got)


def test_other_element_types(spark):
    rows = [(i, v) for i, v in rows_of(60, 5)]
    expected = brute(rows)
    assert result(X.clusters(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))) == expected
    whole = [(1, [3, 4, 0]), (2, [6, 8, 0]), (3, [0, 0, 1]), (4, None)]
    got = result(X.clusters(spark.createDataFrame(whole, "vec_id long, embedding array<int>")))
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 0, 4, True)]


def test_repeated_rows_missing_ids_and_columns(spark):
    v, w = [1.0] + [0.0] * 15, [0.0] * 15 + [1.0]
    df = frame(spark, [(4, v), (4, v), (9, v), (None, v), (None, w)]).withColumn("id", F.lit("x")).withColumn("v", F.lit(1)).withColumn("label", F.lit(3))
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in X.clusters(df).collect()), key=str)
    assert got == sorted([(4, 3, 4, True), (4, 3, 4, True), (9, 3, 4, False), (0, 3, 4, False), (0, 0, None, True)], key=str)
    assert X.clusters(df.limit(0)).count() == 0
    assert X.clusters(frame(spark, ODD[:2])).count() == 2


def test_vectors_of_every_length_are_linked(spark):
    rng = np.random.default_rng(6)
    rows, expected = [], []
    for width, n in ((16, 300), (3, 60), (2, 5), (1, 4), (7, 1)):
        base = rng.normal(size=(n, width))
        base[1::2] = base[: 2 * (n // 2) : 2] + 0.02 * rng.normal(size=(n // 2, width))
        part = [(width * 1000 + i, v) for i, v in enumerate(base.astype(np.float32).tolist())]
        part += [(width * 1000 + 999, part[0][1])]
        rows += part
        a = np.array([v for _, v in part], dtype=np.float64)
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        expected += zip((i for i, _ in part), ((a @ a.T >= 0.95).sum(1) - 1).tolist())
    got = result(X.clusters(frame(spark, rows), recall=0.9999))
    assert [(i, n) for i, n, _, _ in got] == sorted(expected)
    assert all(i // 1000 == c // 1000 for i, _, c, _ in got) and sum(not k for *_, k in got) > 150
