import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallgram.llm import bpe
from tallgram.llm.queries import token_digest

from .conftest import sha256

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
SINGLE = bpe.RankQueue(RANKS)


def ids(text):
    raw = ENCODER.encode_all([text])[0]
    return [int.from_bytes(raw[i : i + 4], "little") for i in range(0, len(raw), 4)]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_as_the_library(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aAb é's\n\t 12=-\U0001f600ñ", max_size=200))
def test_as_the_library_on_few_characters(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)
    one_by_one = [i for p in ENCODER.pattern.findall(text) for i in SINGLE.encode(p.encode())]
    assert one_by_one == ids(text)


@pytest.mark.parametrize("text", ["a" * 30_001, "ab" * 9_000, "aab" * 5_000 + "b" * 99, "=-" * 8_000, " " * 5_000])
def test_long_pre_tokens(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)
    assert SINGLE.encode(text[:999].encode()) == LIBRARY.encode_ordinary(text[:999]) or " " in text


def test_long_texts_in_parts(monkeypatch):
    monkeypatch.setattr(bpe, "LIST_CHARS", 50)
    rng = random.Random(3)
    text = "".join(rng.choice("the cat's 12 über\n ") for _ in range(5_000))
    assert ids(text) == LIBRARY.encode_ordinary(text)


def test_cache_limit():
    small = bpe.Encoder(RANKS, public_tokenizers.PATTERN, entries=3)
    text = "one two three four five qwxz zzxq one two"
    assert small.encode_all([text, text]) == ENCODER.encode_all([text, text])


def test_ranks_that_are_not_closed(tmp_path):
    # 'abc' has a lower rank than both of its parts, so merging whole buckets would not be exact
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"ab": 257, b"bd": 258, b"abcab": 259}
    queue = bpe.RankQueue(ranks)
    library = tiktoken.Encoding("odd", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    for text in ("abcabcab", "abd", "cabcab", "abababc", "abdabcab"):
        assert queue.encode(text.encode()) == library.encode_ordinary(text)
    assert not bpe.closed(bpe.RankQueue(ranks | {b"qrs": 300}))


def test_query_against_the_library(spark, docs):
    texts = ["", None, "Hello  world\n", "Hello  world\n", "x" * 70_000, "naïve  café 12½", " \t\n\x85 "]
    got = {r.doc_id: r for r in token_digest(docs(texts), spark).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        expected = LIBRARY.encode_ordinary(text or "")
        assert got[i].n_tokens == len(expected)
        assert got[i].ids_sha256 == sha256(" ".join(map(str, expected)))
        assert got[i].decoded_sha256 == sha256(text or "")


def test_clashing_columns_repeated_rows_and_empty_tables(spark, docs):
    df = docs([(1, "a b"), (1, "a b"), (None, "c")]).withColumn("token_ids", F.lit("old")).withColumn("decoded", F.lit(1))
    out = bpe.decode(bpe.encode(df, PATH, public_tokenizers.PATTERN), PATH)
    assert out.columns == df.columns
    assert sorted((r.doc_id or 0, bytes(r.decoded)) for r in out.collect()) == [(0, b"c"), (1, b"a b"), (1, b"a b")]
    assert bpe.encode(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
    with_null = spark.createDataFrame([(1, None), (2, [64])], "i int, token_ids array<int>")
    assert sorted((r.i, bytes(r.decoded)) for r in bpe.decode(with_null, PATH).collect()) == [(1, b""), (2, b"a")]
