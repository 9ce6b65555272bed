"""Phrase collocation mining: phrases of two to four words that are frequent and hold together.

Texts in lower case (A-Z) are cut into pieces at punctuation and line ends, pieces into words. Phrases are
counted per language, one length after the other. A frequent phrase has only frequent parts, so from two
words on a task counts those phrases whose two parts of one word less are marked in a bitmap of the
frequent phrases of that length. Before the phrases of the lengths in ``FILTERED`` are counted, a pass adds up
how many fall into each of many hash buckets; a phrase in a bucket with fewer than it needs isn't counted
either. Bitmaps have at most ``BITMAP_BITS`` bits whatever the corpus holds, and their false marks cost work,
not results, as all counts are exact.

Words are counted by Spark from the sums of each slice of texts. Inside a task longer phrases are counted in a HAT-trie: a shallow trie over word ids with hash containers as
leaves. A container that grows over ``BURST`` entries bursts into one container per next word. When a task
holds ``HELD`` entries the largest subtrees are spilled whole, as runs sorted by phrase, into the shuffle. A
run holds phrases of one prefix partition (by language and all words but the last; the last word deals a
prefix to one of ``SALT`` partitions, so that a hot prefix is split); there are as many as the words of the
corpus need for a partition to fit a task, and the runs of each are merged there by summing.

The score of a phrase is its lowest over all cuts in two, floor(2000000 a / (l + r)) with the counts of the
phrase and its parts, in exact decimals. Phrases that lie in a longer one with 100 f(longer) >= 80 a are
dropped. Each language's first ``TOP`` are listed.

Defined results: a null or empty text has no words; a null language is 'und'. Repeated rows are counted
as often as they stand there. Ties are settled by the order of score, count and phrase (bytes). Texts are
worked on in slices of whole texts, a very long one by itself. An empty table gives an empty result. Only
text and lang are read, whatever other columns are there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import lookup, map_arrow, stored
from .blocks import runs
from .multiindex import small_batches
from .text import lower_ascii, mix, text_slices

MIN_COUNT = 30
LONGEST = 4
#: Listed phrases of a language.
TOP = 2000
#: Per cent of a phrase's count that a longer one needs to drop it.
COVER = 80
NO_LANG = "und"

BLANKS = b" \t"
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"

#: Entries of a container before it bursts, and of a task's trie before it spills.
BURST = 4096
HELD = 400_000
#: Partitions that the phrases of one prefix are dealt to, and words of the corpus for each partition.
SALT = 16
PARTITION_WORDS = 200_000
#: Runs in an Arrow batch.
RUN_BATCH = 2000
#: Most bits of a bitmap, and bits for each phrase in a smaller one.
BITMAP_BITS = 1 << 29
BITS_PER_PHRASE = 8
#: Lengths whose phrases are first counted by hash bucket, words of the corpus for each bucket (fewer than
#: half of MIN_COUNT, or the buckets tell nothing), and ranges that buckets are merged in.
FILTERED = (2, 3)
BUCKET_LOAD = 8
RANGES = 64
#: Bucket counts that a task holds.
HELD_BUCKETS = 1 << 21
#: Bytes of text worked on at once.
PART_BYTES = 4 << 20

_RUN_ROWS = 200_000


class Trie:
    """Counts of word-id sequences: nodes by word id, hash containers of the words that remain."""

    def __init__(self):
        self.root: dict = {}  # lang -> container or node
        self.held = 0

    def add(self, lang: str, words: tuple[int, ...], count: int) -> None:
        home, key = self.root, lang
        rest = words
        below = home.get(key)
        while type(below) is Node:
            home, key, rest = below, rest[0], rest[1:]
            below = home.get(key)
        if below is None:
            below = home[key] = {}
        if rest in below:
            below[rest] += count
            return
        below[rest] = count
        self.held += 1
        if len(below) > BURST and len(rest) > 1:
            node = Node()
            for words, n in below.items():
                node.setdefault(words[0], {})[words[1:]] = n
            home[key] = node

    def subtrees(self):
        """(entries, home, key, prefix) of the subtrees that are spilled whole: the children of a
        language's node, or its container."""
        for lang, below in self.root.items():
            if type(below) is Node:
                for word, inner in below.items():
                    yield entries(inner), below, word, (lang, word)
            else:
                yield len(below), self.root, lang, (lang,)

    def spill(self, keep: int):
        """Takes out the largest subtrees until at most ``keep`` entries are held: lists of (lang, words, count)."""
        for size, home, key, prefix in sorted(self.subtrees(), key=lambda s: -s[0]):
            if self.held <= keep:
                break
            yield list(flat(home.pop(key), prefix[0], prefix[1:]))
            self.held -= size


class Node(dict):
    """Word id -> container or node."""


def entries(below) -> int:
    return sum(map(entries, below.values())) if type(below) is Node else len(below)


def flat(below, lang: str, prefix: tuple[int, ...]):
    for key, value in below.items():
        if type(below) is Node:
            yield from flat(value, lang, (*prefix, key))
        else:
            yield lang, (*prefix, *key), value


class Part:
    """Words of one part of the texts: ids into ``words`` (their bytes), and where a piece goes on."""

    def __init__(self, data: np.ndarray, breaks: np.ndarray, langs: np.ndarray):
        """``breaks``: positions at which a text begins; ``langs``: number of the language of each text."""
        inside = _KINDS[data] == 0
        edge = np.ones(len(data) + 1, dtype=bool)
        edge[1:-1] = inside[1:] != inside[:-1]
        begins_text = np.zeros(len(data) + 1, dtype=bool)
        begins_text[breaks] = True
        opens = np.flatnonzero(inside & (edge[:-1] | begins_text[:-1]))
        closes = np.flatnonzero(inside & (edge[1:] | begins_text[1:])) + 1
        text = np.searchsorted(breaks, opens, side="right")
        self.piece = np.searchsorted(np.flatnonzero(_KINDS[data] == 2), opens) + text
        self.lang = langs[text - 1]
        folded = _FOLD[data[inside]]
        offsets = np.concatenate([[0], np.cumsum(closes - opens)])
        column = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(opens), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(folded)]
        ).dictionary_encode()
        self.ids = column.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.dictionary = column.dictionary
        self.words = column.dictionary.to_pylist()
        self.hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), dtype=np.uint64, count=len(self.words))

    def places(self, length: int, lang_hashes: np.ndarray, parts, whole=None) -> tuple[np.ndarray, np.ndarray]:
        """Places of the phrases of ``length`` words whose two parts of one word less are marked in ``parts``,
        and which are marked in ``whole`` themselves (where given), and their hashes."""
        n = len(self.ids) - length + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        at = np.flatnonzero(self.piece[:n] == self.piece[length - 1 :])
        word = [self.hashes[self.ids]]

        def hashed(first: int, size: int) -> np.ndarray:
            return hashes_of([word[0][at + first + k] for k in range(size)], lang_hashes[self.lang[at]])

        if parts is not None:
            for first in (0, 1):
                at = at[parts(hashed(first, length - 1))]
        found = hashed(0, length)
        if whole is not None:
            marked = whole(found)
            at, found = at[marked], found[marked]
        return at, found

    def phrases(self, length: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First place and number of each phrase of ``length`` words among those that begin at ``at``."""
        # equal phrases by pairs of exact numbers: language and first word, then one word more each time
        number = self.lang[at] * len(self.words) + self.ids[at]
        for k in range(1, length):
            number = np.unique(number, return_inverse=True)[1] * len(self.words) + self.ids[at + k]
        _, first, times = np.unique(number, return_index=True, return_counts=True)
        return at[first], times


def hashes_of(words: list[np.ndarray], lang: np.ndarray) -> np.ndarray:
    """64-bit hash of a sequence of words in a language, for the bitmaps."""
    out = lang
    for word in words:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + word)
    return out


def phrase_hashes(langs: list[str], phrases: list[bytes]) -> np.ndarray:
    """The same hash of phrases of one length."""
    of = xxhash.xxh3_64_intdigest
    columns = zip(*(p.split(b" ") for p in phrases))
    words = [np.fromiter(map(of, column), dtype=np.uint64, count=len(phrases)) for column in columns]
    return hashes_of(words, np.fromiter((of(v.encode()) for v in langs), dtype=np.uint64, count=len(langs)))


_FOLD = lower_ascii()
#: 0: byte of a word, 1: blank, 2: end of a piece.
_KINDS = np.zeros(256, dtype=np.uint8)
_KINDS[np.frombuffer(BLANKS, dtype=np.uint8)] = 1
_KINDS[np.frombuffer(PIECE_ENDS, dtype=np.uint8)] = 2


def parts(batch: pa.RecordBatch, numbers: dict[str, int]):
    """The texts (column 0) of a batch with their languages (column 1), as Parts of whole texts."""
    langs = [NO_LANG if v is None else v for v in batch.column(1).to_pylist()]
    langs = np.array([numbers.setdefault(v, len(numbers)) for v in langs], dtype=np.int64)
    for first, data, offsets in text_slices(batch.column(0), PART_BYTES):
        full = np.flatnonzero(np.diff(offsets) > 0)
        if len(full):
            yield Part(data, offsets[full], langs[first + full])


def marks(bitmap: np.ndarray | None):
    """Membership test of hashes in a bitmap of 2^k bits."""
    if bitmap is None:
        return None
    bits = np.uint64(len(bitmap) * 8 - 1)

    def marked(hashes: np.ndarray) -> np.ndarray:
        place = hashes & bits
        return (bitmap[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1

    return marked


def language_hashes(numbers: dict[str, int]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(v.encode()) for v in numbers), dtype=np.uint64, count=len(numbers))


def counted_words(docs: DataFrame) -> DataFrame:
    """lang, phrase and f of all words."""

    def run(batches):
        numbers: dict[str, int] = {}
        for batch in batches:
            for part in parts(batch, numbers):
                first, times = part.phrases(1, np.arange(len(part.ids)))
                langs = pa.array(list(numbers), pa.string())
                words = part.dictionary.cast(pa.binary()).take(pa.array(part.ids[first]))
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(part.lang[first])), words, pa.array(times)], names=["lang", "phrase", "f"])

    return map_arrow(docs, run, "lang string, phrase binary, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def filled_buckets(docs: DataFrame, length: int, shorter: np.ndarray, n_words: int, least: int) -> np.ndarray | None:
    """Bitmap of the hash buckets that ``least`` phrases of ``length`` words or more fall into; None if there
    are so many words that most buckets would be filled."""
    power = max(16, min(BITMAP_BITS.bit_length() - 1, (n_words // BUCKET_LOAD).bit_length()))
    if 2 * n_words > least << power:
        return None
    shared = docs.sparkSession.sparkContext.broadcast(shorter)
    width = np.uint8 if least < 256 else np.uint32
    per_range = (1 << power) // RANGES

    def gather(batches):
        numbers: dict[str, int] = {}
        known = marks(shared.value)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged():
            bucket, count = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(bucket, kind="stable")
            bucket, first = np.unique(bucket[order], return_index=True)
            return bucket, np.minimum(np.add.reduceat(count[order], first), least)

        def rows(bucket, count):
            cuts = np.searchsorted(bucket, np.arange(RANGES + 1) * per_range)
            spans = [(k, low, high) for k, (low, high) in enumerate(zip(cuts, cuts[1:])) if low < high]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k for k, _, _ in spans], pa.int32()),
                    pa.array([(bucket[low:high] - k * per_range).astype(np.uint32).tobytes() for k, low, high in spans], pa.binary()),
                    pa.array([count[low:high].astype(width).tobytes() for _, low, high in spans], pa.binary()),
                ],
                names=["range", "buckets", "counts"],
            )

        for batch in batches:
            for part in parts(batch, numbers):
                _, found = part.places(length, language_hashes(numbers), known)
                if not len(found):
                    continue
                bucket, count = np.unique((found & np.uint64((1 << power) - 1)).astype(np.int64), return_counts=True)
                held.append((bucket, np.minimum(count, least)))
                size += len(bucket)
                if size > HELD_BUCKETS:
                    one = merged()
                    if len(one[0]) > HELD_BUCKETS // 2:
                        yield from rows(*one)
                        held, size = [], 0
                    else:
                        held, size = [one], len(one[0])
        if held:
            yield from rows(*merged())

    def add_up(batches):
        at, sums = None, None
        for batch in batches:
            for k, bucket, count in zip(*(c.to_pylist() for c in batch.columns)):
                if k != at:
                    if at is not None:
                        yield bits_of_range(at, sums, least)
                    at, sums = k, np.zeros(per_range, dtype=np.int64)
                sums[np.frombuffer(bucket, dtype=np.uint32)] += np.frombuffer(count, dtype=width)
        if at is not None:
            yield bits_of_range(at, sums, least)

    found = map_arrow(docs, gather, "range int, buckets binary, counts binary").repartition("range").sortWithinPartitions("range")
    out = np.zeros((RANGES, per_range // 8), dtype=np.uint8)
    for row in map_arrow(found, add_up, "range int, bits binary").toLocalIterator():  # RANGES rows, together one bitmap
        out[row["range"]] = np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
    return out.ravel()


def bits_of_range(number: int, sums: np.ndarray, least: int) -> pa.RecordBatch:
    bits = np.packbits(sums >= least, bitorder="little").tobytes()
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([bits], pa.binary())], names=["range", "bits"])


def counted(docs: DataFrame, length: int, shorter: np.ndarray, buckets: np.ndarray | None, n_words: int, least: int) -> DataFrame:
    """Stored table lang, phrase, f of the phrases of ``length`` words with f >= least."""
    shared = docs.sparkSession.sparkContext.broadcast((shorter, buckets))
    n_parts = max(RANGES, n_words // PARTITION_WORDS)

    def run(batches):
        trie, numbers = Trie(), {}
        ids: dict[bytes, int] = {}
        names: list[bytes] = []
        known, filled = map(marks, shared.value)

        def rows(keep):
            held = []
            for run in trie.spill(keep):
                held += sorted((lang, tuple(names[w] for w in words), count) for lang, words, count in run)
                while len(held) >= _RUN_ROWS:
                    yield run_batch(held[:_RUN_ROWS], n_parts)
                    del held[:_RUN_ROWS]
            if held:
                yield run_batch(held, n_parts)

        for batch in batches:
            for part in parts(batch, numbers):
                langs = list(numbers)
                at, _ = part.places(length, language_hashes(numbers), known, filled)
                if not len(at):
                    continue
                first, times = part.phrases(length, at)
                # task-wide ids of the words that occur in these phrases
                places = part.ids[first[:, None] + np.arange(length)]
                wide = np.zeros(len(part.words), dtype=np.int64)
                for w in np.unique(places).tolist():
                    word = part.words[w]
                    if word not in ids:
                        ids[word] = len(names)
                        names.append(word)
                    wide[w] = ids[word]
                for lang, words, count in zip(part.lang[first].tolist(), map(tuple, wide[places].tolist()), times.tolist()):
                    trie.add(langs[lang], words, count)
                if trie.held > HELD or len(names) > HELD:
                    keep = 0 if len(names) > HELD else HELD // 2
                    yield from rows(keep)
                    if not keep:
                        ids.clear()
                        names.clear()
        yield from rows(0)

    def merge(batches):
        for run in runs(batches, 1):
            held = pa.table([run.column(k).combine_chunks().flatten() for k in range(1, 4)], names=["lang", "phrase", "f"])
            sums = held.group_by(["lang", "phrase"]).aggregate([("f", "sum")])
            sums = sums.filter(pc.greater_equal(sums.column("f_sum"), least))
            if sums.num_rows:
                yield from sums.select(["lang", "phrase", "f_sum"]).rename_columns(["lang", "phrase", "f"]).combine_chunks().to_batches()

    found = map_arrow(docs, run, "part long, lang array<string>, phrase array<binary>, f array<long>")
    with small_batches(docs.sparkSession, RUN_BATCH):
        return stored(map_arrow(found.repartition("part").sortWithinPartitions("part"), merge, "lang string, phrase binary, f long"), f"phrases-{length}")


def run_batch(entries: list[tuple[str, tuple[bytes, ...], int]], n_parts: int) -> pa.RecordBatch:
    """Sorted runs, one for each prefix partition that has any of the entries."""
    rows = sorted((prefix_partition(lang, words) % n_parts, lang, words, count) for lang, words, count in entries)
    part = np.fromiter((r[0] for r in rows), dtype=np.int64, count=len(rows))
    heads = np.flatnonzero(np.diff(part, prepend=-1))
    offsets = pa.array(np.append(heads, len(rows)), pa.int32())
    columns = (pa.array([r[1] for r in rows], pa.string()), pa.array([b" ".join(r[2]) for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.int64()))
    return pa.RecordBatch.from_arrays(
        [pa.array(part[heads]), *(pa.ListArray.from_arrays(offsets, c) for c in columns)], names=["part", "lang", "phrase", "f"]
    )


def prefix_partition(lang: str, words: tuple[bytes, ...]) -> int:
    """Number of a phrase's partition: that of its prefix, one of SALT by its last word."""
    prefix = xxhash.xxh3_64_intdigest(b" ".join((lang.encode(), *words[:-1]))) >> 8
    return prefix + xxhash.xxh3_64_intdigest(words[-1]) % SALT


def bitmap_of(frequent: DataFrame) -> np.ndarray:
    """Bits of the hashes of (lang, phrase): a power of two of them, at most BITMAP_BITS."""
    n = frequent.count()
    bits = 1 << max(16, min(BITMAP_BITS.bit_length() - 1, (n * BITS_PER_PHRASE).bit_length()))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            place = phrase_hashes(batch.column(0).to_pylist(), batch.column(1).to_pylist()) & np.uint64(bits - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array((place >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (place & np.uint64(63))).view(np.int64))], names=["word", "bit"]
            )

    words = map_arrow(frequent.select("lang", "phrase"), run, "word long, bit long").groupBy("word").agg(F.expr("bit_or(bit)").alias("bits"))
    # at most BITMAP_BITS / 64 rows, whatever the corpus holds
    out = np.zeros(bits // 64, dtype=np.int64)
    rows = words.toArrow()
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint8)


def frequent_phrases(docs: DataFrame, text: str, lang: str, least: int) -> tuple[DataFrame, DataFrame]:
    """Stored tables: (lang, phrase, f, length) of all phrases with f >= least, and (lang, n)."""
    plain = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    words = stored(counted_words(plain), "words")
    sizes = stored(words.groupBy("lang").agg(F.sum("f").alias("n")), "words-by-lang")
    n_words = sizes.agg(F.sum("n")).first()[0] or 0
    found = [stored(words.filter(F.col("f") >= least), "phrases-1")]
    for length in range(2, LONGEST + 1):
        shorter = bitmap_of(found[-1])
        buckets = filled_buckets(plain, length, shorter, n_words, least) if length in FILTERED else None
        found.append(counted(plain, length, shorter, buckets, n_words, least))
    tables = [t.withColumn("length", F.lit(k)) for k, t in enumerate(found, 1)]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.withColumn("phrase", F.col("phrase").cast("string")), sizes


def mine(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = MIN_COUNT, cover: int = COVER, top: int = TOP
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first ``top`` phrases."""
    frequent, sizes = frequent_phrases(docs, text, lang, least)
    words = F.split("phrase", " ", -1)
    long = frequent.filter("length > 1").withColumn("words", words)

    def run_of(first, size):
        return F.array_join(F.slice("words", first, size), " ")

    cuts = long.select(
        "lang", "phrase", F.col("f").alias("a"), F.explode(F.expr("sequence(1, length - 1)")).alias("k"), "length", "words"
    ).select("lang", "phrase", "a", "k", run_of(F.lit(1), F.col("k")).alias("left"), run_of(F.col("k") + 1, F.col("length") - F.col("k")).alias("right"))
    known = lookup(frequent.select("lang", "phrase", "f"), "frequent")
    cuts = cuts.join(known.withColumnsRenamed({"phrase": "left", "f": "l"}), ["lang", "left"])
    cuts = cuts.join(known.withColumnsRenamed({"phrase": "right", "f": "r"}), ["lang", "right"])
    score = F.expr("(2000000BD * cast(a as decimal(20,0))) div cast(l + r as decimal(20,0))")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inner = long.filter("length > 2").select(
        "lang", "f", "words", "length", F.explode(F.expr("flatten(transform(sequence(2, length - 1), s -> transform(sequence(1, length - s + 1), p -> struct(p as p, s as s))))")).alias("e")
    ).select("lang", run_of(F.col("e.p"), F.col("e.s")).alias("phrase"), "f")
    covered = inner.groupBy("lang", "phrase").agg(F.max("f").alias("within"))
    kept = scored.join(covered, ["lang", "phrase"], "left").filter(F.col("within").isNull() | (100 * F.col("within") < cover * F.col("a")))

    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("rank", rank).filter(F.col("rank") <= top)
    return best.join(lookup(sizes, "sizes"), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
