import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tallgram.llm import phrases as P

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string"


def counts(rows):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    return f, n


def brute(rows, least=30, top=2000):
    f, n = counts(rows)
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    covered = Counter()
    for (lang, w), a in candidates.items():
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                key = lang, w[i : i + size]
                covered[key] = max(covered[key], a)
    found = {}
    for (lang, w), a in candidates.items():
        if 100 * covered[lang, w] >= 80 * a:
            continue
        cuts = [(2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    out = []
    for lang, rest in found.items():
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rest)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def result(df):
    return sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def corpus(seed, n=250):
    rng = random.Random(seed)
    fixed = ["new york city", "as soon as possible", "ad hoc", "größer als", "the the the the", "a b c"]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.choice([0, 2, 30])):
            words.append(rng.choice(fixed) if rng.random() < 0.3 else f"w{int(rng.expovariate(0.2))}")
            words.append(rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]))
        text = "".join(words)
        rows.append((i, text.upper() if i % 9 == 0 else text, rng.choice(["en", "en", "de", None, "und"])))
    return rows


EDGES = [(900, None, "en"), (901, "", "fr"), (902, "!?;", "en"), (903, "long tail " * 30_000, "de"), (None, "ad hoc", None), (905, "x" * 70_000, "en"), (905, "x" * 70_000, "en")]


def frame(spark, rows, partitions=5):
    return spark.createDataFrame(rows, SCHEMA).repartition(partitions)


@pytest.mark.parametrize("least", [2, 30])
def test_against_brute_force(spark, least):
    rows = corpus(least) + EDGES
    assert result(P.mine(frame(spark, rows), least=least)) == brute(rows, least)


def test_spills_bursts_and_full_bitmaps_change_nothing(spark, monkeypatch):
    rows = corpus(7) + EDGES
    monkeypatch.setattr(P, "HELD", 60)
    monkeypatch.setattr(P, "BURST", 8)
    monkeypatch.setattr(P, "PART_BYTES", 500)
    monkeypatch.setattr(P, "_RUN_ROWS", 5)
    monkeypatch.setattr(P, "HELD_BUCKETS", 40)
    assert result(P.mine(frame(spark, rows), least=5, top=11)) == brute(rows, 5, 11)
    monkeypatch.setattr(P, "marks", lambda bitmap: lambda hashes: np.ones(len(hashes), dtype=bool))  # nothing is pruned
    assert result(P.mine(frame(spark, rows), least=300, top=11)) == brute(rows, 300, 11)


def test_buckets_that_hold_too_few_are_left_out(spark):
    df = frame(spark, [(i, f"a b c{i}", "en") for i in range(40)])
    shorter = np.full(1 << 13, 255, dtype=np.uint8)
    filled = P.filled_buckets(df.select("text", "lang"), 2, shorter, 120, 30)
    assert np.unpackbits(filled).sum() == 1
    assert P.marks(filled)(P.phrase_hashes(["en", "en"], [b"a b", b"b c1"])).tolist() == [True, False]
    assert P.filled_buckets(df.select("text", "lang"), 2, shorter, 1 << 34, 30) is None


def test_trie_holds_counts_through_bursts_and_gives_sorted_subtrees_away():
    rng = random.Random(3)
    trie, plain, P_BURST = P.Trie(), Counter(), P.BURST
    try:
        P.BURST = 16
        for _ in range(5000):
            lang, words = rng.choice("ab"), tuple(int(rng.expovariate(0.3)) for _ in range(3))
            trie.add(lang, words, 2)
            plain[lang, words] += 2
        assert trie.held == len(plain)
        assert any(type(x) is P.Node for x in trie.root["a"].values())
        got = Counter()
        for run in trie.spill(len(plain) // 2):
            assert len({(lang, words[0]) for lang, words, _ in run}) == 1
            got.update({(lang, words): n for lang, words, n in run})
        assert trie.held <= len(plain) // 2 and trie.held == len(plain) - len(got)
        for run in trie.spill(0):
            got.update({(lang, words): n for lang, words, n in run})
        assert got == plain and trie.held == 0
    finally:
        P.BURST = P_BURST


def test_bitmaps_mark_all_phrases_they_are_made_of(spark):
    found = [("en", b"new york"), ("de", b"gr\xc3\xb6\xc3\x9fer als"), ("en", b"a b")]
    bitmap = P.bitmap_of(spark.createDataFrame([(a, bytearray(b)) for a, b in found], "lang string, phrase binary"))
    hashes = P.phrase_hashes([a for a, _ in found], [b for _, b in found])
    assert P.marks(bitmap)(hashes).all()
    assert P.marks(bitmap)(hashes + np.uint64(12345)).sum() == 0
    part = next(P.parts(pa.record_batch({"text": pa.array(["x New\tYork"]), "lang": pa.array(["en"])}), numbers := {}))
    lang = np.array([P.xxhash.xxh3_64_intdigest(v.encode()) for v in numbers], dtype=np.uint64)
    assert part.places(3, lang, P.marks(bitmap))[0].tolist() == []
    at, found = part.places(2, lang, None, P.marks(bitmap))
    assert at.tolist() == [1] and found[0] == hashes[0]


def test_empty_table_and_other_columns(spark):
    df = frame(spark, corpus(4, 60))
    assert P.mine(df.limit(0)).count() == 0
    wide = df.selectExpr("*", "1 AS phrase", "2 AS f", "3 AS part", "4 AS rank")
    assert result(P.mine(wide, least=3)) == brute(corpus(4, 60), 3)
