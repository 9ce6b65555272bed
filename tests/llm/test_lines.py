import random
import re

from pyspark.sql import functions as F

from tallgram.llm import lines as L


def brute(rows, min_sites, share=0.5):
    sites, first = {}, {}
    for i, t, s in rows:
        for x in (t.split("\n") if t is not None else []):
            x = x.strip(" \t\r")
            if x:
                sites.setdefault(x, set()).update([] if s is None else [s])
                if i is not None:
                    first[x] = min(first.get(x, i), i)
    out = []
    for i, t, s in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        parts = t.split("\n")
        hit = [
            len(sites.get(x.strip(" \t\r"), ())) >= min_sites and x.strip(" \t\r") in first and (i is None or i > first[x.strip(" \t\r")])
            for x in parts
        ]
        if sum(hit) > share * sum(bool(x.strip(" \t\r")) for x in parts):
            hit = [False] * len(parts)
        out.append((i, "\n".join(x for x, h in zip(parts, hit) if not h), len(parts), sum(hit)))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)


def result(df):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in df.collect()), key=str)


def rows_of(seed=1, sites=30):
    rng = random.Random(seed)
    common = [f"common line {i}" for i in range(12)]
    rows = []
    for i in range(150):
        own = [f"line {rng.random()}" for _ in range(rng.randint(1, 6))]
        own += [rng.choice(["", " ", "\t"]) + c + rng.choice(["", " \r"]) for k, c in enumerate(common) if rng.random() < 0.06 * k]
        rng.shuffle(own)
        rows.append((i, "\n".join(own), f"s{rng.randrange(sites)}"))
    rows += [(500, None, "s1"), (501, "", "s1"), (502, "\n\n", None), (503, common[11], "s2"), (503, common[11], "s2")]
    rows += [(None, "own\nown2\nown3\n" + common[11], "s3"), (504, "a\nb\nc\n" + common[11], None), (505, "x" * 60_000 + "\n" + common[11], "s4")]
    return rows


def test_against_brute_force(spark):
    rows = rows_of()
    for least in (2, 10, 17):
        assert result(L.without_boilerplate(frame(spark, rows), min_sites=least)) == brute(rows, least)


def test_estimates_near_the_threshold_are_counted(spark):
    # sketches of 16 registers are wrong by a quarter; the exact count of the near ones decides
    rows = [(i, f"own {i}\nmore {i}\nline {i % 7}", f"s{i // 7}") for i in range(7 * 60)] + [(9000 + i, f"z{i}\ny{i}\nline 3", f"t{i}") for i in range(1)]
    before, L.LOG_REGISTERS = L.LOG_REGISTERS, 4
    try:
        assert result(L.without_boilerplate(frame(spark, rows), min_sites=61)) == brute(rows, 61)
    finally:
        L.LOG_REGISTERS = before


def test_columns_empty_table_and_native_plan(spark):
    df = frame(spark, rows_of()).withColumn("n_lines", F.lit("x")).withColumn("line", F.lit(1)).withColumn("id", F.lit(1)).withColumn("h1", F.lit(1))
    out = L.without_boilerplate(df, min_sites=3)
    assert out.columns == [*df.columns, "n_removed"]
    assert out.count() == df.count()
    assert L.without_boilerplate(df.limit(0)).count() == 0
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().toString())


def test_pages_with_a_line_of_their_own_keep_no_boilerplate(spark):
    rows = [(i, f"menu\nfooter\nown {i}", f"s{i}") for i in range(20)] + [(50, "menu\n\nfooter", "s50"), (51, "own\n menu", "s51")]
    got = {i: (t, k) for i, t, _, k in result(L.without_boilerplate(frame(spark, rows), max_share=None))}
    assert got == {0: (rows[0][1], 0), 50: ("menu\n\nfooter", 0), 51: ("own", 1)} | {i: (f"own {i}", 2) for i in range(1, 20)}
