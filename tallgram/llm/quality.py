"""Quality classifier: random-indexing word vectors, pooled per document, and a small network.

Random indexing: every context word has a fixed sparse vector of +1 and -1, drawn from a hash; the
vector of a word is the sum of the context vectors of its neighbours at every place of the corpus.
Words share a fixed number of hash buckets, so the table of vectors has the same size whatever the
corpus holds, while the counts in it cover every word of every document. Tasks add up their own
tables of integers, blocks of them are summed after a shuffle, and only the finished table of
``BUCKETS`` x ``WIDTH`` numbers reaches the driver.

A document is pooled from the vectors of its words: mean, deviation, mean product of neighbours. A two-layer network is fitted
with NumPy on the driver to at most ``SAMPLE_ROWS`` labelled documents (those with the smallest hash
of the id), and its logits are divided by a temperature fitted on a part that training didn't see.

Defined results: null and empty texts are documents without words (the zero vector) and get a score
like any other; repeated rows are scored row by row; null labels and null ids are not learnt from;
of several labels for one id the largest counts, of several texts one. With labels of one kind only every score is that
kind's smoothed share; with none at all every score is 1, as nothing tells against a document. An
empty table stays empty. Columns named like the output are replaced.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import map_arrow
from .bpe import schema_with, with_column
from .text import Words, each_slice, mix, words_and_marks

BUCKETS = 1 << 14
WIDTH = 32
#: Non-zero elements of a context vector, half of them +1 and half -1.
NON_ZERO = 4
#: Neighbours on either side.
REACH = 2
#: Labelled documents that the network is fitted to, at most.
SAMPLE_ROWS = 20_000
HIDDEN = 32
FEATURES = 3 * WIDTH

_BLOCKS = 64
#: Words whose neighbours are counted, and whose vectors are pooled, at once.
_STEP, _POOLED = 1 << 17, 1 << 14


class Model(NamedTuple):
    vectors: np.ndarray  #: BUCKETS x WIDTH, float32
    centre: np.ndarray
    scale: np.ndarray
    layers: tuple  #: weights and biases, or one number: the score of every document
    temperature: float


def context_places() -> np.ndarray:
    """BUCKETS x NON_ZERO places of the non-zero elements of each context vector."""
    cells = np.arange(BUCKETS * NON_ZERO, dtype=np.uint64)
    return (mix(cells + np.uint64(0x1234567)) % np.uint64(WIDTH)).astype(np.int64).reshape(BUCKETS, NON_ZERO)


def bucket_of(words: Words) -> np.ndarray:
    return (words.hashes >> np.uint64(50)).astype(np.int64)


def add_contexts(table: np.ndarray, words: Words, places: np.ndarray) -> None:
    """Add the context vectors of every neighbour pair of the slice to ``table`` (flat, int64)."""
    bucket = bucket_of(words)
    text = np.repeat(np.arange(len(words.counts)), words.counts)
    half = NON_ZERO // 2
    for start in range(0, len(bucket), _STEP):
        for distance in range(1, REACH + 1):
            a = bucket[start : start + _STEP + distance]
            same = text[start : start + _STEP + distance]
            if len(a) <= distance:
                continue
            keep = same[:-distance] == same[distance:]
            left, right = a[:-distance][keep], a[distance:][keep]
            target, context = np.concatenate([left, right]), np.concatenate([right, left])
            cells = target[:, None] * WIDTH + places[context]
            table += np.bincount(cells[:, :half].ravel(), minlength=len(table))
            table -= np.bincount(cells[:, half:].ravel(), minlength=len(table))


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Unit vectors of all word buckets from every text of ``docs``; zero where no word has a neighbour."""

    def gather(batches):
        table, places = np.zeros(BUCKETS * WIDTH, dtype=np.int64), context_places()
        for batch in batches:
            for words in each_slice(batch.column(0), words_and_marks()):
                add_contexts(table, words, places)
        peak = np.abs(table).max()
        if peak:
            width = next(w for w in (1, 2, 4, 8) if peak < 1 << (8 * w - 1))
            parts = table.astype(f"<i{width}").reshape(_BLOCKS, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(_BLOCKS), pa.int32()), pa.array([width] * _BLOCKS, pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())],
                names=["block", "width", "cells"],
            )

    def add_up(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, width, cells in zip(*(c.to_pylist() for c in batch.columns)):
                part = np.frombuffer(cells, dtype=f"<i{width}")
                sums[block] = sums[block] + part if block in sums else part.astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())],
                names=["block", "cells"],
            )

    parts = map_arrow(docs.select(F.col(text).alias("text")), gather, "block int, width int, cells binary")
    sums = map_arrow(parts.repartition(_BLOCKS, "block"), add_up, "block int, cells binary")
    table = np.zeros((_BLOCKS, BUCKETS * WIDTH // _BLOCKS))
    for row in sums.collect():  # _BLOCKS rows, together one table
        table[row["block"]] += np.frombuffer(bytes(row["cells"]), dtype="<i8")
    table = table.reshape(BUCKETS, WIDTH)
    norm = np.linalg.norm(table, axis=1, keepdims=True)
    return (table / np.where(norm > 0, norm, 1)).astype(np.float32)


def pooled(words: Words, vectors: np.ndarray) -> np.ndarray:
    """Per text the mean and the deviation of its word vectors, and the mean product of each vector
    with the one before it, which tells texts that repeat themselves: texts x FEATURES."""
    bucket, starts = bucket_of(words), words.text_starts
    sums = np.zeros((len(words.counts), FEATURES))
    for start in range(0, len(bucket), _POOLED):
        stop = min(start + _POOLED, len(bucket))
        part = vectors[bucket[start:stop]]
        previous = vectors[bucket[np.maximum(np.arange(start, stop) - 1, 0)]]
        first = int(np.searchsorted(starts, start, side="right")) - 1
        last = int(np.searchsorted(starts, stop, side="left"))
        cuts = np.maximum(starts[first:last], start) - start
        full = np.flatnonzero(np.diff(np.append(cuts, stop - start)) > 0)
        heads = starts[first:last][full]
        previous[heads[heads >= start] - start] = 0
        for k, values in enumerate((part, part * part, part * previous)):
            block = np.add.reduceat(values, cuts[full], axis=0, dtype=np.float64)
            sums[first + full, k * WIDTH : (k + 1) * WIDTH] += block
    sums /= np.maximum(words.counts, 1)[:, None]
    mean, square = sums[:, :WIDTH], sums[:, WIDTH : 2 * WIDTH]
    sums[:, WIDTH : 2 * WIDTH] = np.sqrt(np.maximum(square - mean * mean, 0))
    return sums


def with_features(docs: DataFrame, vectors: np.ndarray, text: str = "text", out: str = "features") -> DataFrame:
    """``docs`` with the pooled vector of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            rows = [pooled(w, shared.value) for w in each_slice(column, words_and_marks())]
            if rows:
                yield with_column(batch, out, pa.array(list(np.concatenate(rows)), pa.list_(pa.float64())))

    return map_arrow(docs, run, schema_with(docs.schema, out, T.ArrayType(T.DoubleType())))


def logits(x: np.ndarray, layers: tuple) -> np.ndarray:
    w1, b1, w2, b2 = layers
    return np.tanh(x @ w1 + b1) @ w2 + b2


def train(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, epochs: int = 60, rate: float = 3e-3) -> tuple:
    """Two layers by Adam on the logistic loss with weight decay."""
    layers = [
        rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)),
        np.zeros(HIDDEN),
        rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN),
        np.zeros(1),
    ]
    first, second = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers]
    size, step = 256, 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), size):
            rows = order[at : at + size]
            xs, step = x[rows], step + 1
            hidden = np.tanh(xs @ layers[0] + layers[1])
            error = (1 / (1 + np.exp(-(hidden @ layers[2] + layers[3]))) - y[rows]) / len(rows)
            back = np.outer(error, layers[2]) * (1 - hidden * hidden)
            slopes = [xs.T @ back + 1e-4 * layers[0], back.sum(0), hidden.T @ error + 1e-4 * layers[2], error.sum(keepdims=True)]
            pace = rate * (0.5 * (1 + np.cos(np.pi * epoch / epochs)))
            for k, g in enumerate(slopes):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                layers[k] = layers[k] - pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return tuple(layers)


def fit_temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least logistic loss on rows that training didn't see."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(10), 200))
    if not len(z):
        return 1.0
    losses = [np.mean(np.logaddexp(0, z / t) - y * z / t) for t in grid]
    return float(grid[int(np.argmin(losses))])


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", label: str = "quality", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Word vectors of all ``docs``, and a network fitted to labelled ones. ``labels`` are the rows that
    may be learnt from; of more than ``sample_rows`` ids those with the smallest hash are taken."""
    vectors = word_vectors(docs, text)
    known = (
        labels.select(F.col(id).alias("__id"), F.col(label).cast("double").alias("__y"))
        .dropna()
        .groupBy("__id")
        .agg(F.max("__y").alias("__y"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(sample_rows)
    )
    texts = docs.select(F.col(id).alias("__id"), F.col(text).alias("text")).join(F.broadcast(known), "__id")
    # one row an id, whatever rows share it, so that sample_rows bounds what the driver gets
    rows = with_features(texts, vectors).groupBy("__id", "__y").agg(F.min("features").alias("features")).collect()
    rows.sort(key=lambda r: r["__id"])
    x = np.array([r["features"] for r in rows]).reshape(len(rows), FEATURES)
    y = np.array([r["__y"] for r in rows])
    centre, scale = np.zeros(FEATURES), np.ones(FEATURES)
    if not len(y):
        return Model(vectors, centre, scale, (1.0,), 1.0)
    if y.min() == y.max():
        return Model(vectors, centre, scale, ((y.sum() + 1) / (len(y) + 2),), 1.0)
    centre, scale = x.mean(0), x.std(0) + 1e-6
    x = (x - centre) / scale
    rng = np.random.default_rng(17)
    order = rng.permutation(len(x))
    unseen, seen = order[: len(x) // 5], order[len(x) // 5 :]
    layers = train(x[seen], y[seen], rng)
    return Model(vectors, centre, scale, layers, fit_temperature(logits(x[unseen], layers), y[unseen]))


def with_score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the calibrated probability that each text is of the kind labelled 1, to 12 decimals."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        known = shared.value
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for words in each_slice(column, words_and_marks()):
                if len(known.layers) == 1:
                    scores = np.full(len(words.counts), float(known.layers[0]))
                else:
                    x = (pooled(words, known.vectors) - known.centre) / known.scale
                    scores = 1 / (1 + np.exp(-np.clip(logits(x, known.layers) / known.temperature, -700, 700)))
                # slice by slice, so that what goes back is bounded in bytes too
                part = batch.slice(words.first, len(words.counts))
                yield with_column(part, out, pa.array(np.round(scores, 12)))

    return map_arrow(docs, run, schema_with(docs.schema, out, T.DoubleType()))


def fold(id: str = "doc_id") -> F.Column:
    """crc32 of the id as text, modulo 4: fold 2 is held out."""
    return F.crc32(F.col(id).cast("string").cast("binary")) % 4
