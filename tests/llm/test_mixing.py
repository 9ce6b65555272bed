import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tallgram.llm import mixing as X

SCHEMA = "doc_id long, text string, source string"


def frame(spark, rows, partitions=4):
    return spark.createDataFrame(rows, SCHEMA).repartition(partitions)


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def water(sizes, share=Fraction(3, 2), most=2):
    """Targets by clamping and sharing again, in fractions."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    budget, free, target = share * sum(sizes.values()), set(order), {}
    while free:
        level = budget / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > most * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in free}
        for s in over:
            target[s] = Fraction(most * sizes[s])
            budget -= target[s]
        free -= over
    return target


def brute(rows):
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += words(t)
    target = water(sizes)
    out = []
    for s in sizes:
        mine = sorted((hashlib.md5(f"mix:{'' if i is None else i}:{t or ''}".encode()).hexdigest()[:15], i, words(t)) for i, t, x in rows if x == s)
        whole = int(target[s] / sizes[s]) if sizes[s] else 0
        missing, upto = target[s] - whole * sizes[s], 0
        for _, i, n in mine:
            again = missing > 0 and abs(upto + n - missing) < abs(upto - missing) and upto < missing
            upto += n
            out.append((i, n, sizes[s], round(float(target[s]), 6), n * (whole + again)))
    return Counter(out)


def result(df):
    return Counter((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in df.collect())


def corpus(seed, sources, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        s = rng.choice(sources) if rng.random() < 0.6 else sources[0]
        rows.append((i, " \n\t"[i % 3].join(f"w{rng.randrange(50)}" for _ in range(rng.choice([0, 1, 5, 40]))), s))
    return rows


@pytest.mark.parametrize("sources", [["b", "a", "c"], ["big", None, "ä", "Z", "z", "", "x1", "x2", "x3"], ["only"]])
def test_against_brute_force(spark, sources):
    rows = corpus(len(sources), sources) + [(9000, None, sources[0]), (9001, "", sources[-1]), (None, "a b", sources[0]), (9002, "q " * 30_000, sources[-1])]
    assert result(X.mix(frame(spark, rows))) == brute(rows)


def test_clamped_sources_pass_their_excess_on(spark):
    rows = [(0, "w " * 10, "a"), (1, "w " * 10, "b"), (2, "w " * 1000, "c"), (3, "w " * 100, "d")]
    got = {r.doc_id: (r.target, r.taken) for r in X.mix(frame(spark, rows)).collect()}
    assert got[0] == (20, 20) and got[1] == (20, 20) and got[3] == (200, 200)
    assert got[2][0] == 1.5 * 1120 - 240
    assert X.water_level(spark.createDataFrame([(1.0, 2), (1.0, 4)], "weight double, cap long"), 100.0) is None


def test_a_source_of_copies_is_cut_as_finely_as_any(spark, monkeypatch):
    # one text and no ids: only the place of a row tells the copies apart
    rows = [(None, "a b c", "hot")] * 600 + [(i, "x y", "other") for i in range(300)]
    for few in (X.FEW_ROWS, 10):
        monkeypatch.setattr(X, "FEW_ROWS", few)
        out = X.mix(frame(spark, rows, 7)).groupBy("source").agg(F.sum("taken").alias("n"), F.first("target").alias("t"), F.max("copies").alias("c"))
        for r in out.collect():
            assert abs(r.n - r.t) <= 1.5 and r.c <= 2


def test_long_searches_and_reruns_agree(spark, monkeypatch):
    rows = corpus(5, ["a", "b", "c", "d"], 900)
    expected = brute(rows)
    monkeypatch.setattr(X, "FEW_ROWS", 1)
    assert result(X.mix(frame(spark, rows, 9))) == expected
    assert result(X.mix(frame(spark, rows[::-1], 2))) == expected


def test_columns_empty_table_and_copies_laid_out(spark):
    df = frame(spark, corpus(2, ["a", "b"], 60)).selectExpr("*", "'x' AS row", "1 AS size", "2 AS key", "3 AS copy", "4 AS `a.b`", "5 AS place", "6 AS stop", "7 AS known")
    out = X.mix(df)
    assert set(out.columns) == (set(df.columns) | {"source_size", "target", "copies", "taken"})
    assert out.select("doc_id", "text", "key", "`a.b`", "known").exceptAll(df.select("doc_id", "text", "key", "`a.b`", "known")).isEmpty()
    laid = X.repeated(out)
    assert laid.count() == out.agg(F.sum("copies")).first()[0]
    assert X.mix(df.limit(0)).count() == 0
    nothing = X.mix(frame(spark, [(1, None, None), (1, None, None), (None, " ", "a")]))
    assert result(nothing) == Counter({(1, 0, 0, 0.0, 0): 2, (None, 0, 0, 0.0, 0): 1})
    assert X.mix(df, keep=["doc_id"]).columns == ["doc_id", "size", "source_size", "target", "copies", "taken"]
