"""Benchmark decontamination: word windows of test items looked up in every document.

The windows of all items are hashed into one table, broadcast when its measured bytes are within
the limit of ``session.lookup``; beyond that the lookup is a shuffled join whose skew adaptive execution
splits. Each document is split into words once, its windows are hashed in the same row, exploded and
probed; a hash match counts only if the words are equal. Only hits and one row per document leave
the scan.

Words are runs of ASCII letters (lower-cased), digits and all characters beyond ASCII. An item with
fewer words than a window is one window of its own length; an item without words matches nothing.

Defined results: null and empty texts have no words and no hits. Repeated rows (same id and text)
each keep their own result row; rows with one id and different texts are judged apart, as are rows
without id. Null items match nothing, items without id are named ''. Repeated items count once by
their id. Empty tables give empty results (documents) or no hits (items).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import fits_broadcast, lookup, stored

WINDOW = 10
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str) -> Column:
    """Array of normalised words; empty for null."""
    found = F.regexp_extract_all(F.translate(F.col(text), _UPPER, _LOWER), F.lit(WORD), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


def window_hashes(words: str, length: int) -> Column:
    """xxhash64 of each window of ``length`` words."""
    starts = F.sequence(F.lit(1), F.size(words) - (length - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(F.col(words), i, F.lit(length))))
    return F.when(F.size(words) >= length, hashes).otherwise(F.array().cast("array<bigint>"))


def item_windows(items: DataFrame, window: int, id: str, text: str) -> DataFrame:
    """hash, words, length and the sorted ids (as text) of the items of each distinct window."""
    worded = items.select(F.coalesce(F.col(id).cast("string"), F.lit("")).alias("item"), words_of(text).alias("words"))
    size = F.size("words")
    starts = F.sequence(F.lit(1), F.greatest(size - (window - 1), F.lit(1)))
    return (
        worded.filter(size > 0)
        .select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i, F.lit(window)))).alias("window"))
        .groupBy("window")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
        .select(F.xxhash64("window").alias("hash"), "window", F.size("window").alias("length"), "items")
    )


def merged(windows: str) -> Column:
    """Sorted (pos, length) windows -> maximal covered stretches (first word, end)."""
    empty = F.array().cast("array<struct<first:int,end:int>>")

    def extend(done: Column, x: Column) -> Column:
        last = F.element_at(done, F.lit(-1))
        end = x["pos"] + x["length"]
        stretch = F.named_struct(F.lit("first"), x["pos"], F.lit("end"), end)
        longer = F.named_struct(F.lit("first"), last["first"], F.lit("end"), F.greatest(last["end"], end))
        touches = (F.size(done) > 0) & (F.coalesce(last["end"], F.lit(-1)) >= x["pos"])
        return F.when(touches, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))).otherwise(
            F.concat(done, F.array(stretch))
        )

    return F.aggregate(F.array_sort(windows), empty, extend)


def scan(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", broadcast_bytes: int | None = None,
) -> DataFrame:
    """One row per row of ``docs``: id, text_hash, n_words, spans (array of first word and end) and
    items (sorted ids, as text, of the items with windows in it)."""
    table = stored(item_windows(items, window, item_id, item_text), "item-windows")
    lengths = sorted(r[0] for r in table.select("length").distinct().collect()) or [window]  # window values at most
    small = fits_broadcast(table, broadcast_bytes)
    known = table.select(F.col("hash").alias("h"), F.col("window").alias("w"), "length", "items")
    known = F.broadcast(known) if small else known
    split = docs.select(
        F.col(id).alias("id"), F.xxhash64(F.col(text)).alias("text_hash"), words_of(text).alias("words")
    )
    first = F.lit(None).cast("bigint")  # a row that stands for the document itself
    hashes = F.array(*[
        F.struct(
            F.lit(length).alias("size"),
            (F.concat(F.array(first), window_hashes("words", length)) if k == 0 else window_hashes("words", length)).alias("hashes"),
            F.lit(int(k == 0)).alias("heads"),
        )
        for k, length in enumerate(lengths)
    ])
    rows = (
        split.select("id", "text_hash", "words", F.explode(hashes).alias("of"))
        .select("id", "text_hash", "words", F.col("of.size").alias("size"), F.col("of.heads").alias("heads"), F.posexplode("of.hashes").alias("at", "hash"))
    )
    rows = rows.withColumn("pos", F.col("at") - F.col("heads"))
    words_here = F.slice("words", F.greatest(F.col("pos") + 1, F.lit(1)), F.col("size"))
    if small:
        equal = words_here == F.col("w")
    else:  # the shuffle carries the window itself instead of the whole document
        rows = rows.select("id", "text_hash", "hash", "pos", "size", F.size("words").alias("n"), F.when(F.col("pos") >= 0, words_here).alias("here"))
        equal = F.col("here") == F.col("w")
    n_words = F.size("words") if "words" in rows.columns else F.col("n")
    # joined on the hash alone; the words are compared only where it matches
    hits = rows.join(known, F.col("hash") == F.col("h"), "left").filter((F.col("pos") < 0) | equal)
    return (
        hits.select(
            "id", "text_hash", n_words.cast("long").alias("n_words"), "pos", "items",
            F.when(F.col("pos") >= 0, F.struct("pos", "length")).alias("window"),
        )
        .groupBy("id", "text_hash")
        .agg(
            F.sum(F.when(F.col("pos") < 0, 1)).alias("copies"),
            F.max("n_words").alias("n_words"),
            F.collect_set("window").alias("windows"),
            F.collect_set("items").alias("items"),
        )
        .select(
            F.col("id").alias(id), "text_hash", "n_words", merged("windows").alias("spans"),
            F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"),
            F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
        )
        .drop("copy")
    )


def words_hit(spans: str = "spans") -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])


def without_spans(text: str, spans: str) -> Column:
    """The text without the words of the spans and the marks that follow each of them."""
    parts = F.regexp_extract_all(F.col(text), F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+|" + WORD_GAP), F.lit(0))
    lead = F.when(F.col(text).rlike("^" + WORD_GAP), 1).otherwise(0)

    def stays(part: Column, i: Column) -> Column:
        word = F.floor((i - lead) / 2)
        return (i < lead) | ~F.exists(spans, lambda s: (word >= s["first"]) & (word < s["end"]))

    return F.array_join(F.filter(parts, stays), "")


WORD_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def decontaminate(
    docs: DataFrame, items: DataFrame, remove: str = "documents", id: str = "doc_id", text: str = "text", **options
) -> DataFrame:
    """``docs`` without contaminated documents (``remove="documents"``), or without the hit words
    (``remove="spans"``). All columns stay; a text without hits is unchanged."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove must be 'documents' or 'spans'")
    found = scan(docs, items, id=id, text=text, **options).filter(F.size("spans") > 0)
    hit = found.select(F.col(id).alias("__id"), F.col("text_hash").alias("__hash"), "spans").dropDuplicates(["__id", "__hash"])
    hit = lookup(hit, "contaminated").withColumnRenamed("spans", "__spans")
    same = docs[id].eqNullSafe(F.col("__id")) & (F.xxhash64(docs[text]) == F.col("__hash"))
    if remove == "documents":
        return docs.join(hit, same, "left_anti")
    joined = docs.join(hit, same, "left")
    cleaned = F.when(F.col("__spans").isNull(), F.col(text)).otherwise(without_spans(text, "__spans"))
    return joined.select(*[(cleaned if c == text else F.col(c)).alias(c) for c in docs.columns])
