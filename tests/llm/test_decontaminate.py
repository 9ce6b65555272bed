import re

import pytest
from pyspark.sql import functions as F

from tallgram.llm import decontaminate as D

from .conftest import sha256

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def brute(texts, items, size=10):
    windows = [
        (i, tuple(w[k : k + size])) for i, t in items if (w := words(t)) for k in range(max(1, len(w) - size + 1))
    ]
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for i, win in windows:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    found.add(str(i))
        out.append((len(w), len(hit), sorted(found)))
    return out


LONG = "one two three four five six seven eight nine ten eleven twelve"
TEXTS = [
    f"Start. {LONG.upper()} end", LONG, "one, two; three\nfour five six seven eight nine ten", "über Straße ÜBER",
    None, "", " \t\n", "short item here: über straße and short item", "x " * 3000 + LONG + " y" * 3000, LONG + " " + LONG, LONG, "z" * 50_000,
]
ITEMS = [(1, LONG), (2, "Short item"), (3, None), (4, ""), (10, LONG), (5, "über Straße"), (None, "nine ten eleven"), (6, "!!")]


@pytest.fixture
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("limit", [None, 0])
def test_against_brute_force(docs, items, limit):
    found = {r.doc_id: r for r in D.scan(docs(TEXTS), items, broadcast_bytes=limit).withColumn("n", D.words_hit()).collect()}
    assert len(found) == len(TEXTS)
    expected = brute(TEXTS, [("" if i is None else i, t) for i, t in ITEMS])
    for i, (n_words, n_hit, names) in enumerate(expected):
        assert (found[i].n_words, found[i].n, list(found[i]["items"])) == (n_words, n_hit, names), TEXTS[i]


def test_repeated_rows_and_missing_ids(docs, items):
    rows = [(1, LONG), (1, LONG), (1, "clean"), (None, LONG), (None, "clean")]
    got = sorted((r.doc_id or 0, r.n_words, r.n) for r in D.scan(docs(rows), items).withColumn("n", D.words_hit()).collect())
    assert got == [(0, 1, 0), (0, 12, 12), (1, 1, 0), (1, 12, 12), (1, 12, 12)]


def test_empty_tables_and_clashing_columns(docs, items):
    df = docs(TEXTS).withColumn("hash", F.lit(1)).withColumn("items", F.lit("x")).withColumn("item_id", F.lit(3))
    assert D.scan(df.limit(0), items).count() == 0
    assert {len(r.spans) for r in D.scan(df, items.limit(0)).collect()} == {0}
    kept = D.decontaminate(df, items)
    assert kept.columns == df.columns
    expected = brute(TEXTS, [i for i in ITEMS if i[1]])
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, e in enumerate(expected) if not e[1]]


def test_spans_removed(docs, items):
    df = docs([f"- before {LONG} after.", "clean text", None, f"{LONG}"])
    got = {r.doc_id: r.text for r in D.decontaminate(df, items, remove="spans").collect()}
    assert got == {0: "- before after.", 1: "clean text", 2: None, 3: ""}
    with pytest.raises(ValueError):
        D.decontaminate(df, items, remove="words")


def test_native_plan(docs, items):
    plan = D.scan(docs(TEXTS), items)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert sha256("") == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
