import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallgram.llm import divergence as D

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string"


def brute(rows, min_docs, top=10):
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for _, t, lang, source in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(UPPER))
        counts[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = []
    for lang in docs:
        kept = sorted((t for t, n in docs[lang].items() if n >= min_docs), key=str.encode)
        sources = [s for x, s in counts if x == lang]
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])

        def share(c):
            n = sum(c[t] for t in kept)
            return [1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept]

        p, q = {s: share(counts[lang, s]) for s in sources}, share(whole)
        for s in sources:
            pairs = [(sum((x - y) ** 2 // (x + y) for x, y in zip(p[s], p[o])), o) for o in sources if o != s]
            terms = [((x - y) ** 2 // (x + y), t) for x, y, t in zip(p[s], q, kept) if counts[lang, s][t] and x > y]
            for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda v: (-v[0], v[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(found[:limit], 1)]
    return sorted(out)


def result(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in df.collect())


def corpus(seed, n=300):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "en", "de", None])
        source = rng.choice(["s1", "s2", "s3", "ß", None]) if rng.random() < 0.6 else "hot"
        low = 5 * len(source or "")
        words = [f"{'Wörter'[: rng.randrange(1, 7)]}{chr(97 + rng.randrange(low % 7, 20))}" for _ in range(rng.choice([0, 3, 30]))]
        rows.append((i, rng.choice([" ", "-", "9", "\n"]).join(words), lang, source))
    return rows


EDGES = [
    (900, None, "en", "s1"), (901, "", "xx", "a"), (902, None, "xx", "b"), (903, "word " * 20_000, "en", "s2"),
    (None, "Größe größe", "de", None), (905, "tie tie", "en", "s1"), (905, "tie tie", "en", "s1"), (906, "only here", "a\x1fb", "s"),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.mark.parametrize("limit", [None, 0])
def test_against_brute_force(spark, limit):
    """With the vocabulary in a model, and as a table."""
    rows = corpus(1) + EDGES
    for least in (1, 4):
        assert result(D.audit(frame(spark, rows), min_docs=least, limit=limit)) == brute(rows, least)


def test_blocks_and_stripes_add_up(spark, monkeypatch):
    rows = corpus(2) + EDGES
    monkeypatch.setattr(D, "BLOCK_COUNTS", 7)
    monkeypatch.setattr(D, "STRIPE", 2)
    monkeypatch.setattr(D, "HELD", 50)
    assert result(D.audit(frame(spark, rows), min_docs=2, top=3)) == brute(rows, 2, 3)


def test_shares_beyond_64_bit_products():
    counts = np.array([0, 5, 3 * 10**12, 8 * 10**14])
    total, kept = 9 * 10**14, 10**12
    assert D.shares(counts, total, kept).tolist() == [1 + 10**9 * (int(c) + 2) // (total + 2 * kept) for c in counts]


def test_nothing_kept_empty_table_and_other_columns(spark):
    few = [(i, f"w{chr(97 + i)}", "en", f"s{i}") for i in range(4)]
    assert result(D.audit(frame(spark, few))) == brute(few, 10)
    assert {r[4] for r in brute(few, 10)} == {0}
    assert D.audit(frame(spark, few).limit(0)).count() == 0
    wide = frame(spark, few).selectExpr("*", "1 AS terms", "2 AS count", "3 AS item", "4 AS rank", "5 AS words", "6 AS n")
    assert result(D.audit(wide, min_docs=1)) == brute(few, 1)


def test_sums_travel_packed(spark, monkeypatch):
    """Tasks hand on lists of sums, also when they do so often; what comes out has each index once."""
    monkeypatch.setattr(D, "HELD", 50)
    rows = [(f"l{n % 2}", f"s{n % 3}", [(n * 7 + k * k) % 90 * 101 for k in range(9)]) for n in range(120)]
    sparse = "struct<indices:array<int>,values:array<double>>"
    made = [(a, b, (sorted(set(x)), [float(x.count(i)) for i in sorted(set(x))])) for a, b, x in rows]
    vectors = spark.createDataFrame(made, f"lang string, source string, vector {sparse}").repartition(4)
    sums = D.summed(vectors)
    assert "HashAggregate" not in sums._jdf.queryExecution().executedPlan().toString()
    got = {(r.lang, r.source, r["index"]): r["count"] for r in sums.collect()}
    expected: dict = {}
    for a, b, x in rows:
        for i in x:
            expected[a, b, i] = expected.get((a, b, i), 0) + 1
    assert got == expected and sums.count() == len(expected)


def test_shares_beyond_64_bits(spark):
    frame = spark.createDataFrame([(c, 10**17, 1000) for c in (0, 1, 8999999999, 9000000000, 10**12, 10**16)], "count long, n long, kept long")
    got = [r.p for r in frame.select(D._share("count", "n").cast("long").alias("p")).collect()]
    assert got == [1 + 10**9 * (c + 2) // (10**17 + 2000) for c in (0, 1, 8999999999, 9000000000, 10**12, 10**16)]
