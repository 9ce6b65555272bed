import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tallgram.llm import warc as W


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


def sha1(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def rows_of():
    rng = random.Random(1)
    rows = [(i, f"http://site{i % 4}/p {i}\r\nX: y", "".join(rng.choices("ab<é\r\n", k=rng.choice([0, 3, 50, 900])))) for i in range(40)]
    rows += [(100, None, None), (101, "u", ""), (102, "u", "same"), (103, "u", "same"), (104, "u", "same")]
    rows += [(200, "u", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 30), (201, "u", "WARC/1.1\r\n" * 50), (202, "u", "\r\nWARC/1.1\r\n"), (203, "é" * 40_000)][:4]
    rows[-1] = (203, "u", "é" * 40_000)
    return rows


def expected(rows):
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(last.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        top = last[h or ""]
        out.append((i, len((h or "").encode()), sha1(h), "response" if i == top else "revisit", None if i == top else top))
    return sorted(out)


def result(df):
    return sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect())


@pytest.mark.parametrize("segment", [97, 700, 64 << 10])
def test_round_trip(spark, tmp_path, segment):
    rows = rows_of()
    W.write_archives(frame(spark, rows), f"{tmp_path}/a", segment_bytes=segment)
    pages = W.read_pages(spark, f"{tmp_path}/a")
    assert result(pages) == expected(rows)
    payloads = {r.page_id: bytes(r.payload).decode() for r in pages.filter("record_type = 'response'").collect()}
    assert all(payloads[i] == (h or "") for i, _, h in rows if i in payloads)
    kinds = {r["type"]: r["count"] for r in W.read_records(spark, f"{tmp_path}/a").groupBy("type").count().collect()}
    assert ("continuation" in kinds) == (segment < 1000 or len("é" * 40_000) * 2 > segment)


def test_split_files_and_compression(spark, tmp_path):
    rows = rows_of()
    W.write_archives(frame(spark, rows), f"{tmp_path}/g", segment_bytes=300, compression="gzip")
    assert result(W.read_pages(spark, f"{tmp_path}/g")) == expected(rows)
    W.write_archives(frame(spark, rows).coalesce(1), f"{tmp_path}/s", segment_bytes=300)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        assert result(W.read_pages(spark, f"{tmp_path}/s")) == expected(rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_repeated_rows_and_missing_ids(spark, tmp_path):
    long = "z" * 5000
    rows = [(1, "u", long), (1, "u", long), (2, "u", "a"), (2, "u", "b"), (None, "u", "a"), (None, "u", "c"), (0, "u", long)]
    df = frame(spark, rows).withColumn("key", F.lit("k")).withColumn("payload", F.lit(1)).withColumn("id", F.lit(9))
    W.write_archives(df, f"{tmp_path}/r", segment_bytes=1000)
    got = sorted(((-1 if r.page_id is None else r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in W.read_pages(spark, f"{tmp_path}/r").collect()), key=str)
    assert got == sorted(
        [(1, 5000, "response", None)] * 2 + [(2, 1, "response", None)] * 2 + [(-1, 1, "revisit", 2), (-1, 1, "response", None), (0, 5000, "revisit", 1)], key=str
    )
    W.write_archives(df.limit(0), f"{tmp_path}/e")
    assert W.read_pages(spark, f"{tmp_path}/e").count() == 0


def test_short_payloads_are_not_revisits(spark, tmp_path):
    W.write_archives(frame(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")]), f"{tmp_path}/m", min_revisit=3)
    assert {(r.page_id, r.record_type) for r in W.read_pages(spark, f"{tmp_path}/m").collect()} == {(1, "response"), (2, "response"), (3, "revisit"), (4, "response")}


def test_damage_is_noticed(spark, tmp_path):
    records = W.page_records(1, "u", b"x" * 500, None, 200, W.DATE)
    fields, block = W.parse_record(records[0])
    assert fields["WARC-Segment-Number"] == "1" and len(block) == 200
    with pytest.raises(ValueError):
        W.parse_record(records[0][:-1])
    with pytest.raises(ValueError):
        W.unchunked(b"5\r\nabcdeXX0\r\n\r\n")
    for damaged in (records[:1] + records[2:], records[:-1]):
        spark.createDataFrame([(r.decode(),) for r in damaged], "v string").coalesce(1).write.option("lineSep", "\r\n\r\n").text(f"{tmp_path}/d{len(damaged)}{damaged[-1] == records[-1]}")
        with pytest.raises(Exception):
            W.read_pages(spark, f"{tmp_path}/d{len(damaged)}{damaged[-1] == records[-1]}").collect()


def test_chunks():
    rng = random.Random(2)
    for n in (0, 1, 50, 5000):
        data = rng.randbytes(n)
        assert W.unchunked(W.chunked(data, 64)) == data
    assert W.VERSION not in W.chunked(W.VERSION * 9)
