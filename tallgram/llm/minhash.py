"""Near-duplicate documents by one-permutation hashing.

Each document's set of shingle hashes is cut into ``BINS`` bins by its leading bits; the smallest
hash of a bin is the bin's value. Empty bins borrow from the first full bin in an order of their own
(optimal densification), so that all bins agree between two sets with the probability of their
Jaccard similarity. ``BANDS`` bands of ``ROWS`` bins are bucket keys.

Candidates are stars: in each bucket every document is paired with the smallest id only, so their
number is linear in the bucket. Pairs that a sketch of four bits per bin leaves open are compared on
their full sets. A bucket whose members then lie in one component is settled. In the others a second
centre, the member nearest to what most members have in each bin (the original of a group of edited
copies), gets a star of its own.

What both stars left out is compared in blocks of about ``BLOCK`` members, without rows for pairs. First
the sketches of unsettled buckets: members outside a bucket's most frequent component meet all others, and a
task gives the components that some open pair joins, one row for each joint. Components joined in this way
are a group. Then the full sets of each group, block by block in the same way: a pair is compared
if its ends are in different components and its sketches leave it open, and a task gives the links that
joined two components, fewer than it has members. No pair that shares a bucket is left out.

A pair of exactly 0.75 shares no band with a probability of 5e-6, more similar ones with less. Sets of up to
``FEW_SHINGLES`` have a second signature with as many bands, and sets under ``SKETCHED`` skip the sketch, which
is too rough for them.

Defined results: a text with fewer words than a shingle has its whole word sequence as its one
shingle; null and empty texts have none, link with nothing and stay. Equal sets are one class that
takes part once. Rows that share an id are one document. A row without id gets the component of its
equals, null if they have no id either, and stays only in that case. An empty table gives an empty
result; only id and text are read, whatever other columns are there.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import lookup, map_arrow, stored
from .blocks import runs
from .components import connected
from .multiindex import small_batches
from .text import each_slice, fingerprints, lower_ascii, mix, separators, window_hashes, window_text

SHINGLE = 5
BINS = 512
BANDS = 32
ROWS = 4
#: Links: PERCENT * union <= 100 * intersection.
PERCENT = 75
#: Bits kept of each bin's value in the sketch.
PLANES = 4
#: Bins of 512 that may differ in those bits for a pair to be compared: at 0.75 the mean is 120 and the
#: deviation 9.6.
BINS_APART = 170
#: Shingles under which the sketch of a set isn't used, and up to which it has a second signature: what a
#: set of 32 shingles may link with has 42 at most.
SKETCHED, FEW_SHINGLES = 32, 42
#: Documents for each of whose tasks the small tables about them are laid out.
DOCUMENTS_PER_TASK = 20_000
#: Members, and bytes of their sets, that one side of a comparison in a task holds, about.
BLOCK, BLOCK_BYTES = 1024, 16 << 20
#: Rows of an Arrow batch that holds sets, or texts.
SET_ROWS, TEXT_ROWS = 256, 2000

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def probe_ranks() -> np.ndarray:
    """For each bin the place of every other bin in its order of probing."""
    keys = mix(np.arange(BINS * BINS, dtype=np.uint64) + np.uint64(77)).reshape(BINS, BINS)
    return np.argsort(np.argsort(keys, axis=1), axis=1).astype(np.int16)


def shingle_sets(column: pa.Array, shingle: int = SHINGLE):
    """Sorted distinct shingle hashes of each text, slice by slice: lists of uint64 arrays."""
    kinds, fold = separators(), lower_ascii()
    for words in each_slice(column, kinds, fold):
        hashes = window_hashes(words.hashes, shingle)
        number, _ = window_text(words.text_starts, shingle)
        found = hashes[number]
        ends = np.cumsum(np.maximum(words.counts - shingle + 1, 0))
        whole = fingerprints(words)[:, 0]
        sets, begin = [], 0
        for i, end in enumerate(ends):
            if end > begin:
                one = np.sort(found[begin:end])
                sets.append(one[np.concatenate([[True], one[1:] != one[:-1]])])
            else:
                sets.append(whole[i : i + 1] if words.counts[i] else whole[:0])
            begin = end
        yield sets


def signatures(sets: list[np.ndarray], ranks: np.ndarray) -> np.ndarray:
    """Densified bin values, sets x BINS; rows of empty sets hold _EMPTY."""
    out = np.full((len(sets), BINS), _EMPTY, dtype=np.uint64)
    for row, values in zip(out, sets):
        if not len(values):
            continue
        bins = (values >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
        heads = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
        full = bins[heads]
        row[full] = values[heads]
        if len(full) < BINS:
            empty = np.setdiff1d(np.arange(BINS), full, assume_unique=True)
            row[empty] = row[full[ranks[np.ix_(empty, full)].argmin(axis=1)]]
    return out


def band_keys(values: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """Bucket keys of signatures: rows x BANDS."""
    banded = values[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)
    keys = np.zeros(banded.shape[:2], dtype=np.uint64) + salts[:BANDS]
    for k in range(ROWS):
        keys = mix(keys ^ banded[:, :, k]) + np.uint64(k)
    return keys


def describe(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n (set size), s1 and s2 (hash of the set), bits (some of each bin) and bands (BANDS longs, twice
    as many for small sets)."""

    def run(batches):
        ranks = probe_ranks()
        salts = mix(np.arange(BINS, dtype=np.uint64))
        more = mix(salts + np.uint64(1))
        for batch in batches:
            at = 0
            for sets in shingle_sets(batch.column(1)):
                values = signatures(sets, ranks)
                keys = band_keys(values, salts)
                few = [i for i, x in enumerate(sets) if 0 < len(x) <= FEW_SHINGLES]
                again = band_keys(signatures([np.sort(mix(sets[i] ^ more[0])) for i in few], ranks), more)
                second = dict(zip(few, again))
                bands = [np.concatenate([row, second[i]]) if i in second else row for i, row in enumerate(keys)]
                low = mix(values ^ salts)
                planes = [np.packbits((low >> np.uint64(p) & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64) for p in range(PLANES)]
                bits = np.concatenate(planes, axis=1)
                sizes = [len(s) for s in sets]
                sums = np.array([[int(s.sum(dtype=np.uint64)), int(mix(s ^ salts[1]).sum(dtype=np.uint64))] for s in sets], dtype=np.uint64)
                sums = sums.reshape(len(sets), 2).view(np.int64)
                ends = np.concatenate([[0], np.cumsum([len(x) for x in bands])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(sets)),
                        pa.array(sizes, pa.int64()),
                        pa.array(sums[:, 0]),
                        pa.array(sums[:, 1]),
                        pa.FixedSizeListArray.from_arrays(pa.array(bits.ravel()), PLANES * BINS // 64).cast(pa.list_(pa.int64())),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(bands).view(np.int64))),
                    ],
                    names=["id", "n", "s1", "s2", "bits", "bands"],
                )
                at += len(sets)

    plain = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    return map_arrow(plain, run, "id long, n long, s1 long, s2 long, bits array<long>, bands array<long>")


def may_link(a: str, b: str) -> Column:
    """Sizes and bit sketches of two documents allow the threshold."""
    sizes = 100 * F.least(f"{a}.n", f"{b}.n") >= PERCENT * F.greatest(f"{a}.n", f"{b}.n")
    words = BINS // 64

    def differ(word: int) -> Column:
        planes = [F.col(f"{a}.bits")[p * words + word].bitwiseXOR(F.col(f"{b}.bits")[p * words + word]) for p in range(PLANES)]
        return F.bit_count(reduce(Column.bitwiseOR, planes))

    small = F.least(f"{a}.n", f"{b}.n") < SKETCHED
    return sizes & (small | (reduce(Column.__add__, map(differ, range(words))) <= BINS_APART))


def sets_of(docs: DataFrame, ids: DataFrame, id: str, text: str) -> DataFrame:
    """Stored table id, shingles (sorted hashes as bytes) of the documents in ``ids`` (id)."""
    plain = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))

    def gather(batches):
        for batch in batches:
            at = 0
            for sets in shingle_sets(batch.column(1)):
                raw = pa.array([s.tobytes() for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sets)), raw], names=["id", "shingles"])
                at += len(sets)

    picked = plain.join(lookup(ids.distinct(), "candidates"), "id")
    with small_batches(docs.sparkSession, TEXT_ROWS):
        return stored(map_arrow(picked, gather, "id long, shingles binary"), "shingles")


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets reach the threshold."""
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    shared = int((b[at] == a).sum())
    return 100 * shared >= PERCENT * (len(a) + len(b) - shared)


def confirmed(pairs: DataFrame, sets: DataFrame, tasks: int) -> DataFrame:
    """Stored table of the pairs (a, b) whose full shingle sets reach the threshold."""

    def compare(batches):
        for batch in batches:
            sides = [[np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in batch.column(k)] for k in (2, 3)]
            yield batch.select([0, 1]).filter(pa.array([linked(a, b) for a, b in zip(*sides)], pa.bool_()))

    with small_batches(pairs.sparkSession, SET_ROWS):
        return stored(
            map_arrow(
                pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("of_b")), "b")
                .join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("of_a")), "a")
                .select("a", "b", "of_a", "of_b"),
                compare,
                "a long, b long",
            ).coalesce(tasks),
            "links",
        )


def clusters(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id (named as there), n_shingles, component_id and kept."""
    with small_batches(docs.sparkSession, TEXT_ROWS):
        described = stored(describe(docs, id, text), "minhash")
    # equal sets: one class, named after its smallest id
    tasks = tasks_for(described.count())
    classes = stored(
        described.filter("n > 0")
        .groupBy("n", "s1", "s2")
        .agg(F.min("id").alias("rep"), F.max("id").alias("last"), F.count("*").alias("rows"))
        .filter("rows > 1")
        .select("n", "s1", "s2", "rep"),
        "classes",
    )
    members = stored(
        described.select("id", "n", "s1", "s2")
        .join(classes, ["n", "s1", "s2"], "left")
        .select("id", "n", F.coalesce("rep", "id").alias("rep")),
        "members",
    )
    extra = members.filter("id > rep").select("id").distinct()
    single = described.filter("n > 0 AND id IS NOT NULL").join(extra, "id", "left_anti")
    single = stored(single.dropDuplicates(["id", "s1", "s2"]).select("id", "n", "bits", "bands"), "single")

    keyed = single.select(F.explode("bands").alias("key"), "id")
    centres = stored(
        keyed.groupBy("key").agg(F.min("id").alias("centre"), F.max("id").alias("last")).filter("centre < last").select("key", "centre").coalesce(tasks),
        "centres",
    )
    buckets = stored(keyed.join(centres, "key").select("key", "centre", "id").coalesce(tasks), "buckets")

    sketch = single.select("id", "n", "bits")
    stars = (
        buckets.filter("id > centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
        .join(sketch.select(F.col("id").alias("b"), F.struct("n", "bits").alias("y")), "b")
        .join(sketch.select(F.col("id").alias("a"), F.struct("n", "bits").alias("x")), "a")
        .filter(may_link("x", "y"))
        .select("a", "b")
    )
    stars = stored(stars.coalesce(tasks), "stars")
    sets = sets_of(docs, stars.select(F.col("a").alias("id")).unionByName(stars.select(F.col("b").alias("id"))), id, text)
    labels = stored(connected(confirmed(stars, sets, tasks)), "labels")
    rows = unsettled(buckets.select("key", "id"), sketch, labels, tasks)
    if not rows.isEmpty():
        sets = sets_of(docs, rows.select("id"), id, text)
        labels = merged(labels, confirmed(second_stars(rows, tasks), sets, tasks))
        rows = unsettled(rows.select("key", "id"), sketch, labels, tasks)
    if not rows.isEmpty():
        groups = groups_of(rows, tasks)
        if not groups.isEmpty():
            labels = merged(labels, grouped_links(groups, sets, tasks))
    return (
        members.join(labels.withColumnRenamed("id", "rep"), "rep", "left")
        .select("id", "n", F.coalesce("component", "rep").alias("component_id"))
        .select(
            F.col("id").alias(id),
            F.col("n").alias("n_shingles"),
            "component_id",
            F.when(F.col("component_id").isNull(), True).otherwise(F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))).alias("kept"),
        )
    )


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Components after further links."""
    if links.isEmpty():
        return labels
    return stored(connected(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(links)), "labels")


def tasks_for(rows: int) -> int:
    """Tasks for tables of a few small rows a document."""
    return 6 + rows // DOCUMENTS_PER_TASK


def unsettled(members: DataFrame, sketch: DataFrame, labels: DataFrame, tasks: int) -> DataFrame:
    """Rows (key, id, component, n, bits) of the buckets (key, id) whose members are in two components or
    more; of two members alone the first star has compared the one pair there is."""
    rows = members.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    rows = stored(rows.coalesce(tasks), "bucket-rows")
    mixed = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("members")).filter("low < high AND members > 2")
    rows = rows.join(lookup(mixed.select("key").coalesce(tasks), "mixed-keys"), "key")
    return stored(rows.join(sketch, "id").coalesce(tasks), "unsettled")


def bits_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def bins_apart(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Number of bins in which each of ``many`` sketches differs from ``one``."""
    planes = (many ^ one).view(np.uint64).reshape(len(many), PLANES, -1)  # numpy counts the bits of |x|
    return np.bitwise_count(np.bitwise_or.reduce(planes, axis=1)).sum(axis=1, dtype=np.int64)


def typical(bits: np.ndarray) -> np.ndarray:
    """The sketch that has in each place the bit that most of the given ones have."""
    ones = np.unpackbits(bits.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(bits)).view(np.int64)


def second_stars(rows: DataFrame, tasks: int) -> DataFrame:
    """Stored pairs of each member with its bucket's typical member, if that is in another component."""

    def propose(batches):
        for run in runs(batches, 2):
            bits = bits_of(run.column("bits").combine_chunks())
            apart = bins_apart(typical(bits), bits)
            best = int(apart.argmin())
            yield pa.RecordBatch.from_arrays(
                [run.column("key").slice(best, 1).combine_chunks(), run.column("id").slice(best, 1).combine_chunks(), pa.array([int(apart[best])], pa.int64())],
                names=["key", "id", "apart"],
            )

    sizes = lookup(rows.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("parts")), "bucket-parts")
    dealt = rows.join(sizes, "key").select("key", F.pmod(F.xxhash64("id"), "parts").alias("part"), "id", "bits")
    dealt = dealt.repartition("key", "part").sortWithinPartitions("key", "part", "id")
    best = map_arrow(dealt, propose, "key long, id long, apart long").groupBy("key").agg(F.min(F.struct("apart", "id")).alias("best"))
    centres = rows.join(best.select("key", F.col("best.id").alias("id")), ["key", "id"])
    centres = lookup(centres.select("key", F.struct("id", "component", "n", "bits").alias("x")).coalesce(tasks), "typical")
    met = rows.withColumn("y", F.struct("n", "bits")).join(centres, "key")
    pairs = met.filter((F.col("x.component") != F.col("component")) & may_link("x", "y"))
    return stored(pairs.select(F.least("x.id", "id").alias("a"), F.greatest("x.id", "id").alias("b")).distinct().coalesce(tasks), "second-stars")


class Joints:
    """Union-find over the components met in one task."""

    def __init__(self, components: np.ndarray):
        self.names, self.of = np.unique(components, return_inverse=True)
        self.root = np.arange(len(self.names))  # every component points straight to its root
        self.left = len(self.names)

    def differ(self, one: int, many: np.ndarray) -> np.ndarray:
        return self.root[self.of[many]] != self.root[self.of[one]]

    def join(self, a: int, b: int) -> bool:
        """Joins the components of two members; whether they were apart."""
        a, b = self.root[self.of[a]], self.root[self.of[b]]
        if a == b:
            return False
        self.root[self.root == max(a, b)] = min(a, b)
        self.left -= 1
        return True


def joints(is_open: np.ndarray, component: np.ndarray, n: np.ndarray, bits: np.ndarray, sets: list | None) -> list[tuple[int, int]]:
    """Pairs of members that join components: open members against all others, as far as the sketches,
    and the full sets if given, leave a pair standing. Typical members come first, as they join most."""
    state = Joints(component)
    x, y = np.flatnonzero(is_open), np.flatnonzero(~is_open)
    if state.left == 1 or not len(x) or not len(y):
        return []
    out = []
    for one in x[np.argsort(bins_apart(typical(bits), bits[x]), kind="stable")].tolist():
        rest = y[state.differ(one, y)]
        rest = rest[100 * np.minimum(n[rest], n[one]) >= PERCENT * np.maximum(n[rest], n[one])]
        if not len(rest):
            continue
        apart = bins_apart(bits[one], bits[rest])
        fits = (apart <= BINS_APART) | (np.minimum(n[rest], n[one]) < SKETCHED)
        for other in rest[fits][np.argsort(apart[fits], kind="stable")].tolist():
            if state.root[state.of[other]] == state.root[state.of[one]]:
                continue
            if (sets is None or linked(sets[one], sets[other])) and state.join(one, other):
                out.append((one, other))
        if state.left == 1:
            break
    return out


def dealt_blocks(rows: DataFrame, to: str, size: str) -> DataFrame:
    """``rows`` of groups named by the column ``to`` as (to, i, j, is_open, ...): every open member, one outside
    the group's most frequent component, is to meet every member of another component in the block
    pair (i, j) of one task. ``size`` is the bytes of a row."""
    totals = rows.groupBy(to, "component").agg(F.count("*").alias("members"), F.sum(size).alias("bytes"))
    totals = totals.groupBy(to).agg(
        F.max_by("component", F.struct("members", "component")).alias("main"),
        F.sum("members").alias("all"), F.max("members").alias("most"), F.sum("bytes").alias("bytes"),
    )
    parts = F.greatest(F.ceil(F.col("all") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    open_parts = F.greatest(F.lit(1), F.least(parts, F.greatest(F.ceil((F.col("all") - F.col("most")) / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")))
    totals = lookup(totals.select(to, "main", parts.alias("parts"), open_parts.alias("open_parts")), "block-parts")
    rows = rows.join(totals, to)
    place = F.xxhash64("id")
    x = rows.filter("component != main").select(
        "*", F.pmod(place, "open_parts").alias("i"), F.explode(F.expr("sequence(0L, cast(parts as long) - 1)")).alias("j"), F.lit(True).alias("is_open")
    )
    y = rows.select(
        "*", F.explode(F.expr("sequence(0L, cast(open_parts as long) - 1)")).alias("i"), F.pmod(place, "parts").alias("j"), F.lit(False).alias("is_open")
    )
    return x.unionByName(y).drop("main", "parts", "open_parts")


def groups_of(rows: DataFrame, tasks: int) -> DataFrame:
    """Stored rows (group, id, component, n, bits) of the components that open pairs of sketches join with others."""

    def join(batches):
        for run in runs(batches, 3):
            component = run.column("component").to_numpy()
            is_open = run.column("is_open").to_numpy(zero_copy_only=False)
            found = joints(is_open, component, run.column("n").to_numpy(), bits_of(run.column("bits").combine_chunks()), None)
            if found:
                a, b = component[np.array(found)].T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    blocks = dealt_blocks(rows.withColumn("size", F.lit(256)), "key", "size").select("key", "i", "j", "is_open", "component", "n", "bits")
    blocks = blocks.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    groups = lookup(connected(map_arrow(blocks, join, "a long, b long")).withColumnRenamed("component", "group"), "groups")
    members = rows.select("id", "component", "n", "bits").dropDuplicates(["id"])
    return stored(members.join(groups.withColumnRenamed("id", "component"), "component").select("group", "id", "component", "n", "bits").coalesce(tasks), "group-rows")


def grouped_links(rows: DataFrame, sets: DataFrame, tasks: int) -> DataFrame:
    """Stored links (a, b) that join components of one group, confirmed on the full sets."""

    def join(batches):
        for run in runs(batches, 3):
            id, component, n = (run.column(c).to_numpy() for c in ("id", "component", "n"))
            is_open = run.column("is_open").to_numpy(zero_copy_only=False)
            full = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in run.column("shingles").combine_chunks()]
            found = joints(is_open, component, n, bits_of(run.column("bits").combine_chunks()), full)
            if found:
                a, b = id[np.array(found)].T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    blocks = dealt_blocks(rows.withColumn("size", 8 * F.col("n") + 300), "group", "size").drop("size").join(sets, "id")
    blocks = blocks.select("group", "i", "j", "is_open", "id", "component", "n", "bits", "shingles")
    blocks = blocks.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j")
    with small_batches(rows.sparkSession, SET_ROWS):
        return stored(map_arrow(blocks, join, "a long, b long").coalesce(tasks), "group-links")
