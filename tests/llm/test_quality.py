import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallgram.llm import quality as Q
from tallgram.llm.queries import scored
from tallgram.llm.text import each_slice, words_and_marks

GOOD = "the cat and a dog of this house went to see her friends in town with them".split()
BAD = "buy now!! free $$$ win *** click ### cheap &&& deal".split()


def corpus(n=900, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.3
        words = rng.choices(GOOD if not bad else BAD + GOOD[:4], k=rng.randint(5, 60))
        rows.append((i, " ".join(words)))
        if rng.random() < 0.7:
            labels.append((i, int(not bad), 0))
    return rows, labels


def table(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark, docs):
    rows, labels = corpus()
    got = {r.doc_id: r for r in scored(docs(rows), table(spark, labels)).collect()}
    assert len(got) == len(rows)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    unseen = [(got[i].score, q) for i, q, _ in labels if got[i].held_out]
    assert np.mean([(s >= 0.7) == q for s, q in unseen]) > 0.97
    # calibrated: the mean score is the share of good ones
    assert abs(np.mean([s for s, _ in unseen]) - np.mean([q for _, q in unseen])) < 0.05
    again = {r.doc_id: r.score for r in scored(docs(rows, 7), table(spark, labels)).collect()}
    assert all(again[i] == got[i].score for i in got)


def test_scores_ignore_everything_but_the_text(spark, docs):
    rows, labels = corpus(300)
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    flipped = [(i, 1 - q if i in held else q, t) for i, q, t in labels]
    one = {r.doc_id: r.score for r in scored(docs(rows), table(spark, labels)).collect()}
    two = {r.doc_id: r.score for r in scored(docs(rows).withColumn("lang", F.lit("x")), table(spark, flipped)).collect()}
    assert one == two


def test_word_vectors_against_a_loop(docs):
    texts = ["a b c, d", "b c", "", None, "d a b " * 50]
    vectors = Q.word_vectors(docs(texts))
    places, table = Q.context_places(), np.zeros((Q.BUCKETS, Q.WIDTH))
    for text in texts:
        for words in each_slice(pa.array([text or ""]), words_and_marks()):
            bucket = Q.bucket_of(words)
            for i in range(len(bucket)):
                for j in range(max(0, i - Q.REACH), min(len(bucket), i + Q.REACH + 1)):
                    if i != j:
                        np.add.at(table[bucket[i]], places[bucket[j], :2], 1)
                        np.add.at(table[bucket[i]], places[bucket[j], 2:], -1)
    norm = np.linalg.norm(table, axis=1, keepdims=True)
    assert np.allclose(vectors, table / np.where(norm > 0, norm, 1), atol=1e-6)


def test_pooling_in_steps(monkeypatch):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(Q.BUCKETS, Q.WIDTH)).astype(np.float32)
    column = pa.array(["", "a b c " * 40, None, "x", "y z " * 100, ""])
    words = next(each_slice(column, words_and_marks()))
    whole = Q.pooled(words, vectors)
    bucket, starts = Q.bucket_of(words), words.text_starts
    for i in range(6):
        v = vectors[bucket[starts[i] : starts[i + 1]]].astype(float)
        if len(v):
            parts = [v.mean(0), v.std(0), (v[1:] * v[:-1]).sum(0) / len(v)]
            assert np.allclose(whole[i], np.concatenate(parts), atol=2e-3)
        else:
            assert not whole[i].any()
    monkeypatch.setattr(Q, "_STEP", 7)
    assert np.allclose(Q.pooled(words, vectors), whole, atol=1e-5)


@pytest.mark.parametrize("labels, expected", [([], 1.0), ([(0, 1, 0)] * 3 + [(1, 1, 0)], 0.75), ([(0, 0, 0)], 1 / 3), ([(None, 1, 0), (5, None, 0)], 1.0)])
def test_labels_of_one_kind_or_none(spark, docs, labels, expected):
    df = docs(["some text", "more text here", None, ""])
    model = Q.fit(df, table(spark, labels))
    assert [round(r.score, 9) for r in Q.with_score(df, model).collect()] == [round(expected, 9)] * 4


def test_edges(spark, docs):
    rows, labels = corpus(200)
    rows += [(900, None), (901, ""), (None, "the cat"), (902, "free " * 60_000), (903, "the cat"), (903, "the cat")]
    labels += [(903, 0, 0), (903, 1, 0), (None, 1, 0)]
    df = docs(rows).withColumn("score", F.lit("x")).withColumn("features", F.lit(1)).withColumn("quality", F.lit(0))
    model = Q.fit(df, table(spark, labels))
    out = Q.with_score(df, model)
    assert out.columns == df.columns
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.text == "the cat"}) == 1
    assert len({r.score for r in got if not r.text}) == 1
    assert Q.with_score(df.limit(0), model).count() == 0
    assert Q.fit(df.limit(0), table(spark, labels)).layers == (1.0,)
