import os
import random

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline as C
from tallgram.llm import bpe

from . import test_decontaminate, test_lines, test_minhash
from .conftest import sha256

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus with junk, boilerplate, copies and a leak."""
    rng, path = random.Random(3), str(tmp_path_factory.mktemp("tables"))
    words = [f"{a}{b}" for a in ("ba", "ke", "li", "mo", "nu") for b in ("ra", "se", "ti", "vo", "zu")]
    rows, labels = [], []
    for i in range(220):
        body = [" ".join(rng.choices(words, k=rng.randint(8, 25))) + "." for _ in range(rng.randint(2, 4))]
        kind = i % 11
        if kind == 3:
            body = [" ".join(w + "***" for w in line.split()) for line in body]
        if kind == 5:
            body.insert(0, "share this page with friends")
        if kind == 7:
            body[0] += " " + ITEM + " end"
        text = "\n".join(body)
        if kind == 9:
            text = next(t for j, t, *_ in rows if j % 11 == 1).replace(".", " ,", i % 2)
        rows.append((i, text, "en", f"src{i % 20}", len(text)))
        if i % 2:
            labels.append((i, int(kind != 3), 0))
    rows += [(1000, "", "en", "src1", 0), (1001, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_and_run(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in C.STAGES]
    assert len(names) == 5
    kept = {}
    for name, stage in C.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        path = f"{folder}/{name.replace(' ', '-')}"
        out = stage(spark, docs, folder)
        assert out.columns == COLUMNS
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = (before, {r.doc_id: r for r in docs.collect()})
    before, after = kept["quality classifier"]
    junk = {i for i in before if i < 220 and i % 11 == 3}
    assert len(junk & after.keys()) <= 1 and len(before.keys() - junk - after.keys()) <= 3
    before, after = kept["line dedup"]
    expected = test_lines.brute([(r.doc_id, r.text, r.source) for r in before.values()], 10)
    assert sorted(((i, r.text) for i, r in after.items()), key=str) == sorted(((i, t) for i, t, _, _ in expected), key=str)
    assert any("share" in (r.text or "") for r in before.values()) and sum("share" in (r.text or "") for r in after.values()) == 1
    assert all(r.text is None or r.n_chars == len(r.text) for r in after.values())
    before, after = kept["MinHash near-dedup"]
    expected = test_minhash.brute([(r.doc_id, r.text) for r in before.values()])
    assert after.keys() == {i for i, _, _, stays in expected if stays} and len(after) < len(before)
    before, after = kept["benchmark decontamination"]
    hits = test_decontaminate.brute([r.text for r in before.values()], [(1, ITEM)])
    assert after.keys() == {i for i, h in zip(before, hits) if not h[1]} and len(after) < len(before)
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in C.run(spark, folder).collect()}
    assert got.keys() == after.keys()
    for i, r in after.items():
        ids = library.encode_ordinary(r.text or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha256(" ".join(map(str, ids))), sha256(r.text or ""))


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0


SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_registered_queries_match_their_sql(spark):
    import glob

    import duckdb

    import __spark_entry__ as entry
    from tallgram.llm.queries import ORACLES, QUERIES

    assert [int(n[2:].split("_")[0]) for n in sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= entry.queries().keys()
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).split('.')[0]} AS SELECT * FROM '{path}'")
    for name, sql in ORACLES.items():
        df = QUERIES[name](spark, SF)
        columns = sorted(df.columns)
        got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
        result = con.execute(sql)
        names = [d[0] for d in result.description]
        assert sorted(names) == columns, name
        assert got == sorted(repr(tuple(dict(zip(names, r))[c] for c in columns)) for r in result.fetchall()), name
