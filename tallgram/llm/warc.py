"""WARC archives: writing pages as records, and reading them back with segments put together.

Writing. Payloads are sent in chunked transfer framing inside an HTTP response block. A block longer
than ``segment_bytes`` becomes a first record with segment number 1 and continuation records that
name it as their origin; the last one carries the total length. Of equal payloads the row with the
largest id is the response, others are revisits that refer to it. Spark's text writer lays the
records out, with the two line ends that close a record as its separator, so files are committed as
any other output.

Reading. Files are cut at the version line that starts a record, which makes them splittable; the
writer ends a chunk inside every such line that a payload holds, so the cut never falls into one.
(The line has no part that is both its start and its end, which the reader's search needs.)
``Content-Length`` is checked for every record. Segments are grouped by the id of their origin,
ordered by number and checked for gaps and for the total length before the chunks are decoded; a
group is one page. Payloads are checked against their digests, and revisits are resolved by a join
with the responses. Anything that doesn't fit raises.

Defined results: a null payload is an empty one. Rows that repeat the largest id of a payload are all
responses; rows with one id and different payloads are independent. A row without id is a revisit of
a response with id, or a response if there is none. An empty table gives an empty archive, which
reads as no records; other columns are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import lookup, map_arrow, stored

#: Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SEGMENT_BYTES = 64 << 10
CHUNK_BYTES = 16 << 10
#: Date of capture when the table has none.
DATE = "2000-01-01T00:00:00Z"
_NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "tallgram/warc")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, '/'.join(map(str, parts)))}>"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing; no chunk holds a whole version line."""
    cuts, at = [], payload.find(VERSION)
    while at >= 0:
        cuts.append(at + 2)
        at = payload.find(VERSION, at + 1)
    out, start = [], 0
    for stop in [*cuts, len(payload)]:
        while start < stop:
            end = min(stop, start + size)
            out.append(b"%x\r\n%b\r\n" % (end - start, payload[start:end]))
            start = end
    return b"".join(out) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        out.append(body[at : at + size])
        at += size + 2


def record(block: bytes, **headers) -> bytes:
    """Header and block, without the version line's record before and the end after it."""
    lines = [f"{k.replace('_', '-')}: {v}" for k, v in headers.items() if v is not None]
    return VERSION + "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode() + END + block


def clean_url(url: str | None) -> str | None:
    """The address without characters that a header line can't hold."""
    return None if url is None else "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def page_records(page, url: str | None, payload: bytes, canon, segment_bytes: int, date: str) -> list[bytes]:
    """The records of one page. ``canon``: id of the response with the same payload, None for the page itself."""
    full = hashlib.sha256(payload).hexdigest()
    common = {"WARC_Date": date, "WARC_Target_URI": clean_url(url), "X_Page_Id": page, "WARC_Payload_Digest": f"sha1:{digest(payload)}"}
    if canon is not None and canon != page:
        return [record(b"", WARC_Type="revisit", WARC_Record_ID=record_id("revisit", page, full), **common,
                       WARC_Refers_To=record_id("response", canon, full), WARC_Profile=PROFILE)]
    name = record_id("response", page, full)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    http = {"Content_Type": "application/http; msgtype=response"}
    if len(block) <= segment_bytes:
        return [record(block, WARC_Type="response", WARC_Record_ID=name, **common, **http)]
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    out = [record(parts[0], WARC_Type="response", WARC_Record_ID=name, **common, **http, WARC_Segment_Number=1)]
    for k, part in enumerate(parts[1:], 2):
        total = len(block) if k == len(parts) else None
        out.append(record(part, WARC_Type="continuation", WARC_Record_ID=record_id("segment", page, full, k), WARC_Date=date,
                          WARC_Target_URI=clean_url(url), WARC_Segment_Origin_ID=name, WARC_Segment_Number=k, WARC_Segment_Total_Length=total))
    return out


def write_archives(
    pages: DataFrame, folder: str, segment_bytes: int = SEGMENT_BYTES, min_revisit: int = 0, date: str = DATE,
    compression: str = "none", id: str = "page_id", url: str = "url", html: str = "html",
) -> None:
    """One record or more for each row of ``pages``, in WARC files under ``folder``. Payloads shorter
    than ``min_revisit`` bytes are responses always."""
    rows = pages.select(
        F.col(id).alias("id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload")
    ).withColumn("key", F.sha2("payload", 256))
    same = (
        rows.filter(F.octet_length("payload") >= min_revisit)
        .groupBy("key")
        .agg(F.max("id").alias("canon"), F.count("*").alias("rows"))
        .filter("rows > 1")
        .select("key", "canon")
    )

    def run(batches):
        for batch in batches:
            out = []
            for page, address, payload, canon in zip(*(c.to_pylist() for c in batch.columns)):
                out.extend(page_records(page, address, payload, canon, segment_bytes, date))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    joined = rows.join(lookup(same, "equal-payloads"), "key", "left").select("id", "url", "payload", "canon")
    records = map_arrow(joined, run, "record binary")
    records.select(F.col("record").cast("string")).write.option("lineSep", END.decode()).option("compression", compression).text(folder)


_FIELDS = {
    "WARC-Record-ID": "record_id", "WARC-Type": "type", "X-Page-Id": "page", "WARC-Target-URI": "url",
    "WARC-Payload-Digest": "digest", "WARC-Refers-To": "refers_to", "WARC-Segment-Origin-ID": "origin",
    "WARC-Segment-Number": "number", "WARC-Segment-Total-Length": "total",
}
_RECORD = "record_id string, type string, page string, url string, digest string, refers_to string, origin string, number string, total string"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(fields, block) of one record, whose version line may be cut off."""
    head, end, rest = raw.removeprefix(VERSION).partition(END)
    if not end:
        raise ValueError("a record has no end of its header")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n") if ": " in line)
    size = int(fields["Content-Length"])
    if rest[size:] not in (b"", END) or len(rest) < size:
        raise ValueError(f"record {fields.get('WARC-Record-ID')}: {len(rest)} bytes where {size} are announced")
    return fields, rest[:size]


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record: the header fields of _FIELDS and the block."""
    raw = spark.read.option("lineSep", VERSION.decode()).text(folder).select(F.col("value").cast("binary"))

    def run(batches):
        for batch in batches:
            parsed = [parse_record(raw) for raw in batch.column(0).to_pylist() if raw]
            columns = [pa.array([f.get(name) for f, _ in parsed], pa.string()) for name in _FIELDS]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([b for _, b in parsed], pa.binary())], names=[*_FIELDS.values(), "block"])

    return map_arrow(raw, run, f"{_RECORD}, block binary")


def http_payload(block: bytes) -> bytes:
    head, _, body = block.partition(END)
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def reassembled(records: DataFrame) -> DataFrame:
    """Segmented responses put together: record_id, page, url, digest, block. Records that were
    written more than once come out as often."""
    parts = records.filter("number IS NOT NULL").withColumn("origin", F.coalesce("origin", "record_id"))
    first = F.when(F.col("number") == "1", F.struct("page", "url", "digest"))
    groups = parts.groupBy("origin").agg(
        F.max(first).alias("first"),
        F.sum(F.when(F.col("number") == "1", 1).otherwise(0)).cast("int").alias("copies"),
        F.max(F.col("total").cast("long")).alias("total"),
        F.sort_array(F.collect_set(F.struct(F.col("number").cast("int").alias("number"), "block"))).alias("parts"),
    )

    def run(batches):
        for batch in batches:
            blocks = []
            for origin, total, segments in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if [s["number"] for s in segments] != list(range(1, len(segments) + 1)):
                    raise ValueError(f"segments of {origin} are missing or doubled")
                block = b"".join(s["block"] for s in segments)
                if len(block) != total:
                    raise ValueError(f"segments of {origin} have {len(block)} bytes, not {total}")
                blocks.append(block)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blocks, pa.binary()), batch.column(4)], names=["record_id", "first", "block", "copies"])

    whole = map_arrow(
        groups.select("origin", "first", "total", "parts", "copies"), run,
        "record_id string, first struct<page:string,url:string,digest:string>, block binary, copies int",
    )
    return whole.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select("record_id", "first.page", "first.url", "first.digest", "block")


def read_pages(spark: SparkSession, folder: str, id: str = "page_id") -> DataFrame:
    """One row per archived page: id, url, payload (of responses), payload_bytes, payload_digest,
    record_type and refers_to."""
    records = read_records(spark, folder)
    plain = records.filter("type = 'response' AND number IS NULL").select("record_id", "page", "url", "digest", "block")

    def run(batches):
        for batch in batches:
            payloads = [http_payload(b) for b in batch.column(4).to_pylist()]
            for payload, expected, name in zip(payloads, batch.column(3).to_pylist(), batch.column(0).to_pylist()):
                if f"sha1:{digest(payload)}" != expected:
                    raise ValueError(f"the payload of {name} does not have its digest")
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(payloads, pa.binary())], names=["record_id", "page", "url", "digest", "payload"])

    schema = "record_id string, page string, url string, digest string, payload binary"
    blocks = plain.unionByName(reassembled(records))
    responses = map_arrow(blocks, run, schema).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    targets = responses.select(
        F.col("record_id").alias("refers_to"), F.col("page").alias("target"), "payload_bytes", F.col("digest").alias("found")
    )
    targets = stored(targets.dropDuplicates(["refers_to"]), "responses")
    revisits = records.filter("type = 'revisit'").join(targets, "refers_to", "left")
    fits = F.coalesce(F.col("found") == F.col("digest"), F.lit(False))
    return (
        responses.select("page", "url", "payload", "payload_bytes", "digest", F.lit("response").alias("record_type"), F.lit(None).cast("string").alias("target"))
        .unionByName(
            revisits.select(
                "page", "url", F.lit(None).cast("binary").alias("payload"),
                F.when(fits, F.col("payload_bytes")).otherwise(F.raise_error(F.concat(F.lit("no response for the revisit "), "record_id")).cast("long")).alias("payload_bytes"),
                "digest", F.lit("revisit").alias("record_type"), "target",
            )
        )
        .select(
            F.col("page").cast("long").alias(id), "url", "payload", "payload_bytes", F.regexp_replace("digest", "^sha1:", "").alias("payload_digest"),
            "record_type", F.col("target").cast("long").alias("refers_to"),
        )
    )
