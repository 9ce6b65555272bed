"""Substring de-duplication of word windows, level by level.

Lengths double up to the asked window length: a window can only be repeated if the shorter windows
in it are. The first level takes windows of half the length, and of those only each long window's
smallest hash, which is the same in every copy: about a fifth of the words. Only long windows whose
sampled short window occurs in two documents are extended to the full length, hashed and counted;
what is repeated there is exact for every position. Levels end early when no candidate survives.

Per level the windows are shuffled once, by hash. Passages in very many documents, which a sample of
the documents tells, are kept out of that: tasks hand over the smallest and the largest id of their
windows, a table whose size is bounded, and look their documents' windows up in it. Texts are read again instead of being shuffled: the
surviving stretches of each document travel to them, by broadcast while their bytes are within the
limit of ``session.lookup`` and by a join on the id beyond it.

Hashes have 64 bits; different windows of candidates share one with a probability of about
n^2 / 2^65 in all.

Defined results: null and empty texts have no words; a text shorter than a window loses nothing.
Rows with one id are one document, which never repeats itself; repeated rows are cut alike. Rows
without an id lose nothing and make nothing a repeat. Ties can't arise, as only smaller ids count.
Empty tables stay empty; other columns pass through, those named like an output are replaced.
"""

from __future__ import annotations

from functools import partial
from itertools import compress
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import fits_broadcast, lookup, map_arrow, stored
from .bpe import pieces, schema_with, with_column
from .text import Words, each_slice, separators, window_hashes, window_text

MIN_WORDS = 13
#: A window is taken to be frequent if one of SHARE parts of the documents has it HOT times at least, and
#: in one of COMMON documents.
SHARE, HOT, COMMON = 32, 32, 4096


def sampled(words: Words, short: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts of all windows of ``length`` words, their texts, the place of the smallest ``short``
    window in each, the hashes of all short windows)."""
    hashes = window_hashes(words.hashes, short)
    starts, text = window_text(words.text_starts, length)
    place = starts.copy()
    if len(starts):
        best = hashes[starts]
        for step in range(1, length - short + 1):
            other = hashes[starts + step]
            less = other < best
            best[less] = other[less]
            place[less] = starts[less] + step
    return starts, text, place, hashes


def _plain(docs: DataFrame, id: str, text: str) -> DataFrame:
    return docs.select(
        F.col(id).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("row"), F.col(text).alias("text")
    ).filter("id IS NOT NULL")


_WINDOWS = "hash long, id long, row long, place int"


class Frequent(NamedTuple):
    """Windows in very many documents: their hashes in order, and the ids' range once it is known."""

    hashes: np.ndarray
    least: np.ndarray | None = None
    most: np.ndarray | None = None

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each hash is one of them, its place among them)."""
        if not len(self.hashes):
            return np.zeros(len(hashes), dtype=bool), np.zeros(len(hashes), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return self.hashes[at] == hashes, at


def rows_without(hot: Frequent):
    """Windows one by one, but for the frequent ones: _WINDOWS."""

    def emit(windows):
        for batch, at, hashes, places in windows:
            keep = ~hot.find(hashes)[0]
            if keep.any():
                at = pa.array(at[keep])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[keep]), batch.column(0).take(at), batch.column(1).take(at), pa.array(places[keep].astype(np.int32))],
                    names=["hash", "id", "row", "place"],
                )

    return emit


def ranges_of(hot: Frequent):
    """Per task the smallest and the largest id of each frequent window: hash, least, most."""

    def emit(windows):
        far = np.iinfo(np.int64).max
        least, most = np.full(len(hot.hashes), far), np.full(len(hot.hashes), -far)
        for batch, at, hashes, _ in windows:
            found, k = hot.find(hashes)
            ids = batch.column(0).to_numpy()[at[found]]
            np.minimum.at(least, k[found], ids)
            np.maximum.at(most, k[found], ids)
        seen = least < far
        if seen.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[seen]) for x in (hot.hashes, least, most)], names=["hash", "least", "most"])

    return emit


def places_of(hot: Frequent, smaller: bool):
    """Per document the places of its frequent windows that are repeated: id, row, places."""

    def emit(windows):
        for batch, at, hashes, places in windows:
            found, k = hot.find(hashes)
            ids = batch.column(0).to_numpy()[at]
            found &= (hot.least[k] < (ids if smaller else hot.most[k])) if len(hot.hashes) else False
            if found.any():
                at, places = at[found], places[found].astype(np.int32)
                heads = np.flatnonzero(first_of_run(at))
                lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(at)).astype(np.int32)), pa.array(places))
                rows = pa.array(at[heads])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), lists], names=["id", "row", "places"])

    return emit


def short_windows(docs: DataFrame, short: int, length: int, emit, schema: str) -> DataFrame:
    """The sampled short windows of every document; place is the number among them."""

    def windows(batches):
        for batch in batches:
            for words in each_slice(batch.column(2), separators()):
                _, text, place, hashes = sampled(words, short, length)
                new = first_of_run(place)
                place, text = place[new], text[new]
                if len(place):
                    yield batch, words.first + text, hashes[place].view(np.int64), np.arange(len(text)) - np.searchsorted(text, text)

    return map_arrow(docs, lambda batches: emit(windows(batches)), schema)


def first_of_run(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[True], values[1:] != values[:-1]]) if len(values) else np.zeros(0, dtype=bool)


def covered(runs: pa.ListArray, sizes: np.ndarray) -> np.ndarray:
    """Marks of the numbers in each row's runs, for rows of the given sizes one after the other."""
    marks = np.zeros(int(sizes.sum()) + 1, dtype=np.int32)
    begin = np.cumsum(sizes) - sizes
    at = np.repeat(begin, np.diff(runs.offsets.to_numpy())) + runs.flatten().to_numpy()
    np.add.at(marks, at[0::2], 1)
    np.add.at(marks, at[1::2], -1)
    return np.cumsum(marks[:-1]) > 0


def long_windows(docs: DataFrame, known: DataFrame, short: int, length: int, emit, schema: str) -> DataFrame:
    """Windows of ``length`` words whose sampled short window is in one of the row's runs; place is
    the window's first word."""

    def windows(batches):
        for batch in batches:
            for words in each_slice(batch.column(2), separators()):
                starts, text, place, _ = sampled(words, short, length)
                if not len(starts):
                    continue
                new = first_of_run(place)
                sizes = np.bincount(text[new], minlength=len(words.counts))
                marks = covered(batch.column(3).slice(words.first, len(words.counts)), sizes)
                keep = marks[np.cumsum(new) - 1]
                starts, text = starts[keep], text[keep]
                if len(starts):
                    hashes = window_hashes(words.hashes, length)[starts].view(np.int64)
                    yield batch, words.first + text, hashes, starts - words.text_starts[text]

    joined = docs.join(known, ["id", "row"]).select("id", "row", "text", "runs")
    return map_arrow(joined, lambda batches: emit(windows(batches)), schema)


def frequent(windows_of, docs: DataFrame) -> Frequent:
    """Windows that are probably in a ``1 / COMMON`` part of the documents or more, from a sample of
    these. There are at most COMMON times as many as a document has windows. Which ones they are
    affects the cost only; if they take more bytes than may be broadcast, none is treated apart."""
    some = docs.filter(F.pmod(F.xxhash64("id"), F.lit(SHARE)) == 0)
    least = max(HOT, some.select("id").count() // COMMON)
    found = stored(windows_of(some, rows_without(Frequent(np.zeros(0, np.int64))), _WINDOWS).groupBy("hash").count().filter(F.col("count") >= least).select("hash"), "frequent")
    hashes = found.toArrow()["hash"].to_numpy() if fits_broadcast(found) else np.zeros(0)
    return Frequent(np.sort(hashes.astype(np.int64)))


def repeated(windows_of, docs: DataFrame, smaller: bool) -> DataFrame:
    """Runs (id, row, runs) of the windows that occur in two documents, or with ``smaller`` in a
    document with a smaller id. Most windows are shuffled once, by hash, and see the ids of their
    hash there. Of frequent ones each task hands over the ids' range, and every document's are then
    looked up where it is read."""
    hot = frequent(windows_of, docs)
    if len(hot.hashes):
        ranges = windows_of(docs, ranges_of(hot), "hash long, least long, most long")
        table = ranges.groupBy("hash").agg(F.min("least").alias("least"), F.max("most").alias("most")).toArrow().sort_by("hash")
        hot = Frequent(*(table[c].to_numpy() for c in ("hash", "least", "most")))
    same = Window.partitionBy("hash")
    rows = windows_of(docs, rows_without(hot), _WINDOWS).withColumn("least", F.min("id").over(same)).withColumn("most", F.max("id").over(same))
    found = rows.filter("least < id" if smaller else "least < most").groupBy("id", "row").agg(F.collect_list("place").alias("places"))
    if len(hot.hashes):
        found = found.unionByName(windows_of(docs, places_of(hot, smaller), "id long, row long, places array<int>"))
        found = found.groupBy("id", "row").agg(F.flatten(F.collect_list("places")).alias("places"))

    def run(batches):
        for batch in batches:
            runs = []
            for places in batch.column(2):
                at = np.unique(places.values.to_numpy())
                cuts = np.flatnonzero(np.diff(at) > 1)
                edges = np.stack([at[np.concatenate([[0], cuts + 1])], at[np.concatenate([cuts, [len(at) - 1]])] + 1], axis=1)
                runs.append(edges.astype(np.int32).ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(runs, pa.list_(pa.int32()))], names=["id", "row", "runs"])

    return map_arrow(found, run, "id long, row long, runs array<int>")


def _short(short: int, length: int, docs: DataFrame, emit, schema: str) -> DataFrame:
    return short_windows(docs, short, length, emit, schema)


def _long(known: DataFrame, short: int, length: int, docs: DataFrame, emit, schema: str) -> DataFrame:
    return long_windows(docs, known, short, length, emit, schema)


def removable(docs: DataFrame, min_words: int = MIN_WORDS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, row (hash of the text) and runs (pairs of first and end): first words of the windows of
    ``min_words`` words that also start in a document with a smaller id."""
    plain = _plain(docs, id, text)
    length = max(1, (min_words + 1) // 2)
    known = lookup(repeated(partial(_short, length, min_words), plain, length == min_words), "runs")
    while length < min_words and not known.isEmpty():
        short, length = length, min(2 * length, min_words)
        last = known
        known = lookup(repeated(partial(_long, last, short, length), plain, length == min_words), "runs")
    return known


def without_repeats(
    docs: DataFrame, min_words: int = MIN_WORDS, id: str = "doc_id", text: str = "text",
    out: str = "kept_text", n_words: str = "n_words", n_removed: str = "n_removed",
) -> DataFrame:
    """``docs`` with the words that are left, joined by one space, and the numbers of words and of
    words removed."""
    runs = removable(docs, min_words, id, text).select(
        F.col("id").alias("__id"), F.col("row").alias("__row"), F.col("runs").alias("__runs")
    )
    joined = docs.join(
        runs, (docs[id].cast("long") == F.col("__id")) & (F.xxhash64(docs[text]) == F.col("__row")), "left"
    ).drop("__id", "__row")

    def run(batches):
        for whole in batches:
            for batch in pieces(whole, text) if whole.num_rows else ():
                kept, counts, removed = [], [], []
                lists = batch.column(batch.schema.get_field_index("__runs"))
                for raw, starts in zip(batch.column(batch.schema.get_field_index(text)).to_pylist(), lists):
                    words = (raw or "").encode().split()  # at the separators of text.BLANKS
                    gone = 0
                    if starts.is_valid:
                        edges = np.zeros(len(words) + 1, dtype=np.int32)
                        at = starts.values.to_numpy()
                        np.add.at(edges, at[0::2], 1)
                        np.add.at(edges, at[1::2] - 1 + min_words, -1)
                        stay = np.cumsum(edges[:-1]) == 0
                        gone = len(words) - int(stay.sum())
                        counts.append(len(words))
                        words = list(compress(words, stay.tolist()))
                    else:
                        counts.append(len(words))
                    kept.append(b" ".join(words))
                    removed.append(gone)
                batch = batch.drop_columns(["__runs"])
                for name, values in (
                    (out, pa.array(kept, pa.binary()).cast(pa.string())),
                    (n_words, pa.array(counts, pa.int64())),
                    (n_removed, pa.array(removed, pa.int64())),
                ):
                    batch = with_column(batch, name, values)
                yield batch

    schema = docs.schema
    for name, kind in ((out, T.StringType()), (n_words, T.LongType()), (n_removed, T.LongType())):
        schema = schema_with(schema, name, kind)
    return map_arrow(joined, run, schema)
