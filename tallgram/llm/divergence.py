"""Source divergence audit: how far the term distributions of a language's sources are apart.

The terms of a document are its runs of letters and of characters beyond ASCII, with A-Z in lower
case. A language keeps the terms that stand in at least ``MIN_DOCS`` of its documents. A sparse count
vector per document is built by a CountVectorizer with the largest vocabSize. One model holds the terms
that any language keeps, and what another language keeps is taken off the sums. Its minDF is applied per
language by an aggregation beforehand, so that the vocabulary's bytes are known before it goes to the driver;
one beyond the broadcast limit stays a table, and the counts are joined with it instead (equal results).
Sparse vectors are summed per language and source inside the tasks, then by Spark.

A group's smoothed share of a term is p = 1 + floor(SCALE * (count + 2) / (N + 2 V)) with N its kept
occurrences and V the language's kept terms; the distance of two shares is floor((p - q)^2 / (p + q)),
all in integers. Two sources are compared over all V terms, but computed over the terms they have: where
neither has a term the distance is a constant, where only one has it it depends on that one's count
alone, and only terms of both need a pair of counts. Terms are dealt to blocks, each block adds its
part of every pair, and Spark sums the parts. A block holds a bounded number of counts, and of a language
with very many sources a stripe of ``STRIPE`` of them against all.

Defined results: null text, lang and source are read as ''. Every group that occurs is compared with every
other source of its language, also groups without terms; a language that keeps no term has distances of
0. Repeated rows are documents of their own. An empty table gives an empty result. Ties go to the smaller
item by bytes. Only the three columns are read, whatever others are there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import fits_broadcast, lookup, map_arrow, ship, stored
from .text import lower_ascii, text_slices

#: Documents of a language that a term must stand in.
MIN_DOCS = 10
SCALE = 1_000_000_000
#: Terms listed per group.
TOP_TERMS = 10
#: Counts in one block, about, and the sources of one stripe.
BLOCK_COUNTS = 100_000
STRIPE = 1_000
#: Summed counts that a task holds before it hands them on, and terms of one packed row of them.
HELD, PACKED = 1 << 21, 1 << 12


#: 1 for the bytes of a term: letters and all bytes beyond ASCII.
_TERM_BYTES = np.zeros(256, dtype=bool)
for _low, _high in ((65, 91), (97, 123), (128, 256)):
    _TERM_BYTES[_low:_high] = True
_FOLD = lower_ascii()


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
    """All terms of the texts of one slice in order, and how many each text has."""
    inside = _TERM_BYTES[data]
    edge = np.ones(len(data) + 1, dtype=bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[offsets[:-1]] = True  # a text starts a term, and ends that of the text before
    opens, closes = np.flatnonzero(inside & edge[:-1]), np.flatnonzero(inside & edge[1:]) + 1
    ends = np.concatenate([[0], np.cumsum(closes - opens)]).astype(np.int32)
    terms = pa.StringArray.from_buffers(len(opens), pa.py_buffer(ends), pa.py_buffer(_FOLD[data[inside]]))
    return terms, np.diff(np.searchsorted(opens, offsets))


def plain_rows(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """text, lang and source, null read as ''."""
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))))


def with_terms(rows: DataFrame) -> DataFrame:
    """lang, source and the array of terms of each document."""

    def run(batches):
        for batch in batches:
            for first, data, offsets in text_slices(batch.column(0)):
                terms, counts = terms_of(data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), terms)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(first, len(counts)) for k in (1, 2)), lists], names=["lang", "source", "terms"])

    return map_arrow(rows, run, "lang string, source string, terms array<string>")


def vocabulary(rows: DataFrame, min_docs: int) -> DataFrame:
    """Stored table (lang, term) of the terms in at least ``min_docs`` documents of a language."""

    def run(batches):
        for batch in batches:
            langs = batch.column(1).dictionary_encode()
            for first, data, offsets in text_slices(batch.column(0)):
                terms, counts = terms_of(data, offsets)
                terms = terms.dictionary_encode()
                if not len(terms):
                    continue
                size = len(terms.dictionary)
                text = np.repeat(np.arange(len(counts)), counts)
                once = np.unique(text * size + terms.indices.to_numpy())  # each term once a document
                lang = langs.indices.to_numpy()[first:][once // size].astype(np.int64)
                key, docs = np.unique(lang * size + once % size, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [langs.dictionary.take(pa.array(key // size)), terms.dictionary.take(pa.array(key % size)), pa.array(docs.astype(np.int64))],
                    names=["lang", "term", "docs"],
                )

    parts = map_arrow(rows.select("text", "lang"), run, "lang string, term string, docs long")
    return stored(parts.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs).select("lang", "term"), "terms")


def summed(vectors: DataFrame) -> DataFrame:
    """Sums of the sparse ``vector`` per lang and source: lang, source, index, count. Tasks add up what
    they read and hand on sums of at most about ``HELD`` entries at a time, as lists of a group's sums of a
    block of ``PACKED`` indexes; blocks are added up one after the other."""

    def run(batches):
        names: dict[tuple[str, str], int] = {}
        keys, counts, size = [], [], 0

        def merged():
            key, value = np.concatenate(keys), np.concatenate(counts)
            key, place = np.unique(key, return_inverse=True)
            total = np.zeros(len(key), dtype=np.int64)
            np.add.at(total, place, value)
            return key, total

        def batch_of(key, total):
            group = list(names)
            lang = pa.array([g[0] for g in group], pa.string())
            source = pa.array([g[1] for g in group], pa.string())
            index = (key & np.int64(0xFFFFFFFF)).astype(np.int32)
            block = key // PACKED  # of a group and its indexes, as PACKED divides 1 << 32
            heads = np.flatnonzero(np.diff(block, prepend=-1))
            at, edges = pa.array(key[heads] >> np.int64(32)), pa.array(np.append(heads, len(key)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(edges, pa.array(x)) for x in (index, total)]
            return pa.RecordBatch.from_arrays(
                [lang.take(at), source.take(at), pa.array(index[heads] // PACKED), *lists], names=["lang", "source", "block", "index", "count"]
            )

        for batch in batches:
            number = [names.setdefault(g, len(names)) for g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            vector = batch.column(2)
            index, value = vector.field("indices"), vector.field("values")
            rows = np.diff(index.offsets.to_numpy())
            group = np.repeat(np.array(number, dtype=np.int64), rows)
            keys.append(group << np.int64(32) | index.flatten().to_numpy().astype(np.int64))
            counts.append(value.flatten().to_numpy().astype(np.int64))
            size += len(group)
            if size > HELD:
                key, total = merged()
                if len(key) > HELD // 2:
                    yield batch_of(key, total)
                    keys, counts, size = [], [], 0
                else:
                    keys, counts, size = [key], [total], len(key)
        if size:
            yield batch_of(*merged())

    packed = map_arrow(vectors, run, "lang string, source string, block int, index array<int>, count array<long>")
    packed = packed.repartition("lang", "source", "block").sortWithinPartitions("lang", "source", "block")
    return map_arrow(packed, _added_blocks, "lang string, source string, index int, count long")


def _added_blocks(batches):
    """Sums of rows sorted by lang, source and block; what is held are the sums of the last, still open block."""
    name, start, total = None, 0, np.zeros(PACKED, dtype=np.int64)

    def done():
        index = np.flatnonzero(total)
        names = [pa.array([x] * len(index), pa.string()) for x in name[:2]]
        return pa.RecordBatch.from_arrays([*names, pa.array((start + index).astype(np.int32)), pa.array(total[index])], names=["lang", "source", "index", "count"])

    for batch in batches:
        held = []
        offsets = batch.column("index").offsets.to_numpy()
        offsets = offsets - offsets[0] if len(offsets) else offsets
        index, count = (batch.column(c).flatten().to_numpy() for c in ("index", "count"))
        for row, own in enumerate(zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "block")))):
            if own != name:
                if name is not None:
                    held.append(done())
                name, start = own, own[2] * PACKED
                total = np.zeros(PACKED, dtype=np.int64)
            low, high = offsets[row], offsets[row + 1]
            total[index[low:high] - start] += count[low:high]  # each index once a row
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
    if name is not None:
        yield done()


def indexed(vectors: DataFrame) -> DataFrame:
    """term and index of one-term vectors."""

    def run(batches):
        for batch in batches:
            index = batch.column(1).field("indices")
            yield pa.RecordBatch.from_arrays([batch.column(0), index.flatten().cast(pa.int32())], names=["term", "index"])

    return map_arrow(vectors, run, "term string, index int")


def counted(rows: DataFrame, kept: DataFrame, limit: int | None = None) -> DataFrame:
    """Stored table lang, source, item, count of the kept terms; count > 0."""
    documents = with_terms(rows)
    terms = stored(kept.select("term").distinct(), "all-terms")
    if terms.isEmpty() or not fits_broadcast(terms, limit):
        each = documents.select("lang", "source", F.explode("terms").alias("term")).groupBy("lang", "source", "term").agg(F.count("*").alias("count"))
    else:
        # the table holds what reaches minDF, each term once; its bytes were checked
        learner = CountVectorizer(inputCol="terms", outputCol="vector", minDF=1.0, vocabSize=2**31 - 1)
        alone = terms.select("term", F.array("term").alias("terms"))
        model = learner.fit(alone)
        sums = summed(model.transform(documents).select("lang", "source", "vector"))
        each = sums.join(F.broadcast(indexed(model.transform(alone).select("term", "vector"))), "index")
    known = lookup(kept, "kept-terms")
    return stored(each.join(known, ["lang", "term"]).select("lang", "source", F.col("term").alias("item"), "count"), "counts")


def shares(counts: np.ndarray, total: int, kept: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (total + 2 kept)), digit by digit, so that nothing passes 64 bits."""
    divisor = np.int64(total + 2 * kept)
    rest = counts.astype(np.int64) + 2
    out = rest // divisor
    rest = rest % divisor
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // divisor
        rest = rest % divisor
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def block_pairs(number: np.ndarray, item: np.ndarray, count: np.ndarray, totals: np.ndarray, kept: int, low: int, high: int):
    """Parts of the distances of the pairs a < b with b in [low, high): arrays a, b, value.

    ``number`` (of the source), ``item`` (any ids) and ``count`` are the counts of one block of terms;
    ``totals`` are the kept occurrences of every source of the language."""
    sources = len(totals)
    n_items = len(np.unique(item))
    none = np.array([shares(np.zeros(1, dtype=np.int64), int(t), kept)[0] for t in totals])
    share = np.zeros(len(count), dtype=np.int64)
    order = np.argsort(number, kind="stable")
    bounds = np.searchsorted(number[order], np.arange(sources + 1))
    for s in range(sources):
        at = order[bounds[s] : bounds[s + 1]]
        share[at] = shares(count[at], int(totals[s]), kept)
    # shares of one source are few: each kept once, with how many terms have it
    has = np.diff(bounds)
    single, times, owner = [], [], []
    for s in range(sources):
        value, n = np.unique(share[order[bounds[s] : bounds[s + 1]]], return_counts=True)
        single.append(value)
        times.append(n)
        owner.append(np.full(len(value), s))
    single, times, owner = map(np.concatenate, (single, times, owner))
    sums = np.zeros((sources, high - low), dtype=np.int64)
    for b in range(low, high):
        # terms of a only, counted as if b had none of a's terms ...
        np.add.at(sums[:, b - low], owner, apart(single, none[b]) * times)
        # ... and terms of b only, against every a
        mine = owner == b
        sums[:, b - low] += (apart(single[mine][None, :], none[:, None]) * times[mine]).sum(axis=1)
        # terms of neither; a term of both is taken off twice here and put right below
        sums[:, b - low] += (n_items - has - has[b]) * apart(none, none[b])
    # terms of both
    order = np.lexsort((number, item))
    number, item, share = number[order], item[order], share[order]
    step = 1
    while step < len(item):
        left = np.flatnonzero(item[step:] == item[:-step])
        if not len(left):
            break
        a, b = number[left], number[left + step]
        inside = (b >= low) & (b < high)
        left, a, b = left[inside], a[inside], b[inside]
        p, q = share[left], share[left + step]
        both = apart(p, q) - apart(p, none[b]) - apart(none[a], q) + apart(none[a], none[b])
        np.add.at(sums, (a, b - low), both)
        step += 1
    a, b = np.nonzero(np.arange(sources)[:, None] < np.arange(low, high)[None, :])
    return a, b + low, sums[a, b]


def pair_sums(counts: DataFrame, groups: DataFrame, sizes: DataFrame) -> DataFrame:
    """lang, a, b (numbers of sources, a < b) and value, from counts (lang, number, item, count), groups
    (lang, number, n) and sizes (lang, kept, sources, blocks, stripes)."""
    deal = sizes.select("lang", "kept", "sources", "blocks", "stripes")
    stripe = F.explode(F.expr("sequence(0, stripes - 1)")).alias("stripe")
    rows = counts.join(deal, "lang").select(
        "lang", F.pmod(F.xxhash64("item"), "blocks").cast("int").alias("block"), stripe, "kept", "number", "item", "count", F.lit(True).alias("term")
    )
    # every block knows the kept occurrences of every source of its language
    totals = groups.join(deal, "lang").select(
        "lang", F.explode(F.expr("sequence(0, cast(blocks as int) - 1)")).alias("block"), "stripes", "kept", "number", "n"
    ).select("lang", "block", stripe, "kept", "number", F.lit(None).cast("string").alias("item"), F.col("n").alias("count"), F.lit(False).alias("term"))

    def run(table: pa.Table) -> pa.Table:
        term = table.column("term").to_numpy(zero_copy_only=False)
        number, count = (table.column(c).to_numpy() for c in ("number", "count"))
        item = table.column("item").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        totals = np.zeros(int(number[~term].max()) + 1, dtype=np.int64)
        totals[number[~term]] = count[~term]
        low = table.column("stripe")[0].as_py() * STRIPE
        high = min(low + STRIPE, len(totals))
        a, b, value = block_pairs(number[term], item[term], count[term], totals, table.column("kept")[0].as_py(), low, high)
        lang = pa.array([table.column("lang")[0].as_py()] * len(a), pa.string())
        return pa.table({"lang": lang, "a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()), "value": pa.array(value)})

    ship(counts.sparkSession)
    parts = rows.unionByName(totals).groupBy("lang", "block", "stripe").applyInArrow(run, "lang string, a int, b int, value long")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def _share(count: str, total: str) -> Column:
    """The share, in 64-bit integers where the product fits them, else in exact decimals."""
    return F.expr(
        f"CASE WHEN {count} < 9000000000 THEN 1 + ({SCALE}L * ({count} + 2)) div ({total} + 2 * kept) "
        f"ELSE 1 + ({SCALE}BD * cast({count} + 2 as decimal(20,0))) div cast({total} + 2 * kept as decimal(20,0)) END"
    )


def audit(
    docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, text: str = "text", lang: str = "lang", source: str = "source",
    limit: int | None = None,
) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item (other source, or term), value and rank of every group.

    Pairs are listed whole; of terms that a group has more of than its language the first ``top``.
    ``limit`` bounds the bytes of a vocabulary that goes to the driver."""
    rows = plain_rows(docs, text, lang, source)
    counts = counted(rows, vocabulary(rows, min_docs), limit)
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = rows.select("lang", "source").distinct().join(
        counts.groupBy("lang", "source").agg(F.sum("count").alias("n")), ["lang", "source"], "left"
    )
    groups = stored(groups.select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), number.alias("number")), "groups")
    # kept terms of a language are those that any of its groups has
    kept = counts.groupBy("lang", "item").agg(F.sum("count").alias("all_count"), F.count("*").alias("rows"))
    kept = stored(kept, "kept")
    sizes = groups.groupBy("lang").agg(F.count("*").alias("sources"), F.sum("n").alias("all_n")).join(
        kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("rows").alias("rows")), "lang", "left"
    )
    most = F.greatest(F.lit(BLOCK_COUNTS), F.least(F.col("sources") * F.col("sources"), F.lit(4_000_000)))
    sizes = lookup(
        sizes.select(
            "lang", "sources", "all_n", F.coalesce("kept", F.lit(0)).alias("kept"),
            (1 + F.floor(F.coalesce("rows", F.lit(0)) / most)).cast("long").alias("blocks"),
            F.ceil(F.col("sources") / STRIPE).cast("int").alias("stripes"),
        ),
        "sizes",
    )
    numbered = counts.join(lookup(groups, "numbers"), ["lang", "source"])

    some = sizes.filter("kept > 0")
    sums = pair_sums(numbered.select("lang", "number", "item", "count"), groups.join(some, "lang", "left_semi").select("lang", "number", "n"), some)
    ends = groups.select("lang", "source", "number")
    of_a, of_b = (lookup(ends.select("lang", F.col("source").alias(f"source_{x}"), F.col("number").alias(x)), f"ends-{x}") for x in "ab")
    pairs = sums.join(of_a, ["lang", "a"]).join(of_b, ["lang", "b"]).select("lang", "source_a", "source_b", "value")
    # languages without kept terms: all distances are 0
    bare = groups.join(sizes.filter("kept = 0"), "lang", "left_semi")
    zero = bare.select("lang", F.col("source").alias("source_a")).join(bare.select("lang", F.col("source").alias("source_b")), "lang").filter("source_a < source_b")
    pairs = pairs.unionByName(zero.withColumn("value", F.lit(0).cast("long")))
    pairs = pairs.select(
        "lang", F.explode(F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item")))).alias("e"), "value"
    ).select("lang", "e.source", "e.item", "value")

    terms = numbered.join(kept.select("lang", "item", "all_count"), ["lang", "item"]).join(sizes.select("lang", "kept", "all_n"), "lang")
    terms = terms.select("lang", "source", "item", _share("count", "n").alias("p"), _share("all_count", "all_n").alias("q")).filter("p > q")
    terms = terms.select("lang", "source", "item", F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    order = ["lang", "source", "part", "item", "value", "rank"]
    return (
        pairs.withColumn("part", F.lit("pair")).withColumn("rank", rank).select(order)
        .unionByName(terms.withColumn("part", F.lit("term")).withColumn("rank", rank).filter(F.col("rank") <= top).select(order))
    )
