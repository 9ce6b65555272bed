import random
import re

import numpy as np
from pyspark.sql import functions as F

from tallgram.llm import minhash as M
from tallgram.llm.components import connected

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)], least[find(i)] == d) for i, (d, _) in enumerate(rows))


def result(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect())


def corpus(seed, groups=12, copies=9):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    rows, n = [], 0
    for _ in range(groups):
        base = rng.choices(words, k=rng.choice([3, 5, 8, 20, 60, 200]))
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((rng.randrange(10**6) * 1000 + n, (" \n\t"[n % 3]).join(w) if n % 5 else " ".join(w).upper()))
            n += 1
    return rows


def test_against_brute_force(docs):
    rows = corpus(1) + [(-1, None), (-2, ""), (-3, " \n"), (-4, "a b"), (-5, "A  b"), (-6, "q " * 30_000), (-7, "Q " * 9)]
    assert result(M.clusters(docs(rows, 4))) == brute(rows)


def test_chains_that_a_star_leaves_open(docs, monkeypatch):
    # neighbours in a chain are linked, others mostly not; the smallest id is at one end
    rng = random.Random(2)
    base = [f"c{i}" for i in range(120)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(base)))
        for _ in range(2):
            base[rng.randrange(len(base))] = f"n{rng.random()}"
    shared = " ".join(f"p{i}" for i in range(60))
    rows += [(1000 + i, shared + " " + " ".join(f"{i}x{j}" for j in range(30))) for i in range(40)]
    expected = brute(rows)
    assert result(M.clusters(docs(rows, 4))) == expected
    # the same with blocks of a few members, so that most pairs are of two blocks
    monkeypatch.setattr(M, "BLOCK", 3)
    monkeypatch.setattr(M, "SET_ROWS", 5)
    assert result(M.clusters(docs(rows, 4))) == expected


def test_small_sets_exactly_at_the_threshold(docs):
    """Sets of 3 to 28 shingles, each with one that has exactly 0.75 in common, and one just below."""
    rows, n = [], 0
    for k in range(60):
        for size in (4, 8, 12, 16, 20, 28):
            words = [f"k{k}s{size}w{i}" for i in range(size + 4)]
            rows.append((n, " ".join(words)))
            rows.append((n + 1, " ".join(words[: 3 * size // 4 + 4])))  # a prefix: 3/4 of the shingles
            rows.append((n + 2, " ".join(words[: 3 * size // 4 + 3])))  # one shingle less: linked with the second at most
            n += 3
    for k in range(60):
        for size in (7, 14, 21):  # both ends changed: 6 of 8 and so on
            words = [f"q{k}s{size}w{i}" for i in range(size + 4)]
            rows.append((n, " ".join(words)))
            rows.append((n + 1, " ".join([*words[: size + 4 - size // 7], *(f"x{i}" for i in range(size // 7))])))
            n += 2
    assert result(M.clusters(docs(rows, 4))) == brute(rows)


def test_edited_copies_that_only_their_original_links(docs, monkeypatch):
    # copies agree with the original in more than 0.75, with each other in less; the original has no small id
    rng = random.Random(8)
    base = [f"b{i}" for i in range(300)]
    rows = [(500, " ".join(base))]
    for i in range(120):
        w = list(base)
        for at in rng.sample(range(300), 8):
            w[at] = f"e{i}_{at}"
        rows.append((i if i < 100 else 600 + i, " ".join(w)))
    expected = brute(rows)
    assert len({r[2] for r in expected}) < 20
    assert result(M.clusters(docs(rows, 4))) == expected
    monkeypatch.setattr(M, "BLOCK", 16)
    monkeypatch.setattr(M, "second_stars", lambda rows, tasks: rows.limit(0).selectExpr("id AS a", "id AS b"))
    assert result(M.clusters(docs(rows, 4))) == expected


def test_bins_apart_counts_bins():
    rng = np.random.default_rng(6)
    values = rng.integers(0, 2**64, (9, M.BINS), dtype=np.uint64)
    values[1:, :300] = values[0, :300]
    planes = [np.packbits((values >> np.uint64(p) & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64) for p in range(M.PLANES)]
    bits = np.concatenate(planes, axis=1)
    low = values & np.uint64((1 << M.PLANES) - 1)
    assert M.bins_apart(bits[0], bits).tolist() == (low != low[0]).sum(axis=1).tolist()
    assert M.bins_apart(bits[0], M.typical(bits[[0, 0, 1]])[None, :]).tolist() == [0]


def test_joints_skip_what_is_joined():
    rng = np.random.default_rng(1)
    sets = [np.sort(rng.choice(40, 30, replace=False)).astype(np.uint64) for _ in range(30)]
    bits = np.zeros((30, M.PLANES * M.BINS // 64), dtype=np.int64)
    is_open = np.array([True] * 15 + [False] * 15)
    component, n = np.arange(30), np.full(30, 30)
    found = M.joints(is_open, component, n, bits, sets)
    state = M.Joints(component)
    for a, b in found:
        assert is_open[a] and not is_open[b] and M.linked(sets[a], sets[b]) and state.join(a, b)
    whole = M.Joints(component)
    for a in range(15):
        for b in range(15, 30):
            if M.linked(sets[a], sets[b]):
                whole.join(a, b)
    assert (state.root == whole.root).all()


def test_repeated_rows_missing_ids_and_columns(docs):
    text = "one two three four five six seven"
    df = docs([(3, text), (3, text), (5, text), (None, text), (None, "alone here"), (7, "other words entirely")])
    got = sorted(((r.doc_id or 0, r.component_id, r.kept) for r in M.clusters(df.withColumn("id", F.lit("x")).withColumn("n", F.lit(1))).collect()), key=str)
    assert got == sorted([(3, 3, True), (3, 3, True), (5, 3, False), (0, 3, False), (0, None, True), (7, 7, True)], key=str)
    assert M.clusters(df.limit(0)).count() == 0


def test_bins_agree_with_the_similarity():
    rng = np.random.default_rng(3)
    ranks = M.probe_ranks()
    for size in (4, 12, 60, 900):
        agree = []
        for _ in range(60):
            shared, a, b = (np.sort(rng.integers(0, 2**64, k, dtype=np.uint64)) for k in (3 * size // 4, size // 8 or 1, size // 8 or 1))
            x, y = np.sort(np.concatenate([shared, a])), np.sort(np.concatenate([shared, b]))
            s = M.signatures([x, y], ranks)
            agree.append((s[0] == s[1]).mean())
        true = len(shared) / (len(shared) + len(a) + len(b))
        assert abs(np.mean(agree) - true) < 0.08


def test_components(spark):
    rng = random.Random(4)
    for pairs in ([], [(i, i + 1) for i in range(200)], [(0, i) for i in range(1, 300)], [(rng.randrange(200), rng.randrange(200)) for _ in range(90)]):
        root = {}

        def find(i):
            while root.setdefault(i, i) != i:
                i = root[i]
            return i

        for a, b in pairs:
            if a != b:
                x, y = sorted((find(a), find(b)))
                root[y] = x
        expected = sorted((i, find(i)) for i in list(root))
        got = connected(spark.createDataFrame(pairs, "a long, b long"))
        assert sorted(map(tuple, got.collect())) == expected
