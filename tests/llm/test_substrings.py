import random
import re

from pyspark.sql import functions as F

from tallgram.llm import substrings as S


def brute(rows, size=13):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, w in split:
        if i is not None:
            for k in range(len(w) - size + 1):
                win = tuple(w[k : k + size])
                least[win] = min(least.get(win, i), i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - size + 1):
            if i is not None and least[tuple(w[k : k + size])] < i:
                gone.update(range(k, k + size))
        out.append((i, " ".join(x for k, x in enumerate(w) if k not in gone), len(w), len(gone)))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.kept_text, r.n_words, r.n_removed) for r in df.collect()), key=str)


def test_against_brute_force(docs):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)]
    shared = [" ".join(rng.choices(vocabulary, k=n)) for n in (12, 13, 14, 30, 60)]
    rows = []
    for i in range(60):
        parts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 40))) for _ in range(3)]
        parts[1:1] = rng.sample(shared, rng.randint(0, 2))
        rows.append((rng.choice([i, i + 1000]), "\n".join(parts)))
    rows += [(2000, None), (2001, ""), (2002, " \t\n"), (2003, shared[4]), (2003, shared[4]), (None, shared[4]), (2004, "é " + shared[1])]
    rows += [(2005, "a " * 40_000 + shared[3]), (2006, "a " * 30), (-7, shared[3].replace(" ", "\x0b"))]
    assert result(S.without_repeats(docs(rows, 5))) == brute(rows)


def test_frequent_windows(docs, monkeypatch):
    monkeypatch.setattr(S, "SHARE", 2)
    monkeypatch.setattr(S, "HOT", 4)
    rng = random.Random(8)
    shared = [" ".join(f"{c}{i}" for i in range(40)) for c in "ab"]
    rows = [(i, f"x{i} " * 9 + rng.choice(shared) + f" y{i}" * rng.randint(1, 20)) for i in range(50)] + [(99, "u v w " * 9), (98, "u v w " * 8)]
    assert result(S.without_repeats(docs(rows, 5))) == brute(rows)


def test_every_length(docs):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices("ab", k=30))) for i in range(12)]
    for size in (1, 2, 3, 5, 8):
        assert result(S.without_repeats(docs(rows), min_words=size)) == brute(rows, size)


def test_columns_and_empty_table(docs):
    df = docs([(1, "x " * 20), (2, "x " * 20)]).withColumn("kept_text", F.lit(0)).withColumn("id", F.lit("a")).withColumn("hash", F.lit(1))
    out = S.without_repeats(df)
    assert out.columns == [*df.columns, "n_words", "n_removed"]
    assert {(r.doc_id, r.n_removed, r.id) for r in out.collect()} == {(1, 0, "a"), (2, 20, "a")}
    assert S.without_repeats(df.limit(0)).count() == 0
