"""Byte-level BPE encoding and decoding with a rank queue on a hierarchical bitmap.

A pre-token is a doubly linked list of tokens. Each rank has a bucket with the list positions at
which a pair of that rank was seen; a two-level bitmap marks the non-empty buckets, and
find-first-set gives the lowest rank. Entries whose pair has changed meanwhile are stale and
skipped. A step costs the same however long the pre-token is, so n bytes take O(n log n) at most
(the logarithm is that of a bucket kept in order of position, which settles ties to the left).

Defined results: a null or empty text has no tokens (an empty array, decoded to empty bytes);
repeated rows are encoded row by row; other columns pass through, one that is named like the output
is replaced. A null array of ids decodes to empty bytes, a null or unknown id raises. An empty table
stays empty.
"""

from __future__ import annotations

import base64
import itertools
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..session import map_arrow

#: Pre-tokens whose ids a task remembers, about; when there are more the half that came up last stays.
#: Results don't depend on it.
CACHE_ENTRIES = 300_000
#: Tokens that are decoded at once; a longer row goes by itself.
DECODE_TOKENS = 1 << 20
#: Characters of the texts whose pre-tokens are listed at once; a longer text is worked through in parts.
LIST_CHARS = 3 << 19
#: Longest pre-token that is remembered and merged together with others; longer ones have a queue each.
SHORT_CHARS = 48

_WORD_BITS = 8


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte strings and ranks of a rank file: one base64 string and number a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def pair_ranks(ranks: dict[bytes, int]) -> dict[int, int]:
    """Rank of each pair of tokens whose concatenation is a token, by first * 2^32 + second."""
    out = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            first, second = ranks.get(token[:cut]), ranks.get(token[cut:])
            if first is not None and second is not None:
                out[first << 32 | second] = rank
    return out


class RankQueue:
    """Merges one pre-token at a time; its bitmap and buckets are empty in between."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.pairs = pair_ranks(ranks)
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.buckets: dict[int, list[int]] = {}
        self.words = [0] * ((max(ranks.values()) >> _WORD_BITS) + 1)
        self.top = 0

    def push(self, seen: list[int], at: int, rank: int) -> None:
        seen[at] = rank
        if rank < 0:
            return
        if rank in self.buckets:
            heappush(self.buckets[rank], at)
        else:
            self.buckets[rank] = [at]
            self.words[rank >> _WORD_BITS] |= 1 << (rank & 255)
            self.top |= 1 << (rank >> _WORD_BITS)

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        single, pair_of, buckets, words = self.single, self.pairs.get, self.buckets, self.words
        token = [single[b] for b in piece]
        n = len(token)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        seen = [-1] * n  # rank of the pair that starts here, -1: none or swallowed
        for i in range(n - 1):
            rank = pair_of(token[i] << 32 | token[i + 1], -1)
            if rank >= 0:
                seen[i] = rank
                if rank in buckets:
                    buckets[rank].append(i)  # in order of position, so a heap
                else:
                    buckets[rank] = [i]
                    words[rank >> _WORD_BITS] |= 1 << (rank & 255)
                    self.top |= 1 << (rank >> _WORD_BITS)
        while self.top:
            high = (self.top & -self.top).bit_length() - 1
            word = words[high]
            rank = high << _WORD_BITS | ((word & -word).bit_length() - 1)
            bucket = buckets[rank]
            i = heappop(bucket)
            if not bucket:
                del buckets[rank]
                words[high] = word & (word - 1)
                if not words[high]:
                    self.top &= self.top - 1
            if seen[i] != rank:
                continue
            j = after[i]
            k = after[j]
            token[i], after[i] = rank, k
            seen[j] = token[j] = -1
            seen[i] = -1
            if k < n:
                before[k] = i
                self.push(seen, i, pair_of(rank << 32 | token[k], -1))
            h = before[i]
            if h >= 0:
                self.push(seen, h, pair_of(token[h] << 32 | rank, -1))
        return [t for t in token if t >= 0]


class BatchQueue:
    """The same queue over many short pre-tokens laid out as one linked list with breaks.

    A bucket holds the positions of one rank in all of them and is merged in one NumPy step. That
    equals merging one by one, leftmost first, if a merge never makes a pair of a lower rank than its
    own, which holds when every token of the vocabulary is what its bytes are merged to (``closed``).
    """

    def __init__(self, queue: RankQueue):
        self.queue = queue
        keys = np.fromiter(queue.pairs.keys(), dtype=np.int64, count=len(queue.pairs))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.ranks = np.append(np.fromiter(queue.pairs.values(), dtype=np.int64, count=len(order))[order], -1)
        self.single = np.array(queue.single, dtype=np.int64)

    def rank_of(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        key = first << 32 | second
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """int32 ids of each non-empty piece, as bytes."""
        lengths = np.array([len(p) for p in pieces])
        ends = np.cumsum(lengths)
        token = self.single[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        n = len(token)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1], before[ends - lengths] = n, n  # n: beyond the piece
        after, before = np.append(after, n), np.append(before, n)
        token = np.append(token, -1)
        seen = np.where(after < n, self.rank_of(token, token[after]), -1)
        found = np.flatnonzero(seen >= 0)
        found = found[np.argsort(seen[found], kind="stable")]
        cuts = np.flatnonzero(np.diff(seen[found])) + 1
        first = {int(seen[p[0]]): p for p in np.split(found, cuts)} if len(found) else {}
        later: dict[int, list[int]] = {}
        words, top = self.queue.words, 0
        for rank in first:
            words[rank >> _WORD_BITS] |= 1 << (rank & 255)
            top |= 1 << (rank >> _WORD_BITS)
        while top:
            high = (top & -top).bit_length() - 1
            word = words[high]
            rank = high << _WORD_BITS | ((word & -word).bit_length() - 1)
            words[high] = word & (word - 1)
            if not words[high]:
                top &= top - 1
            at = first.pop(rank, None)
            if rank in later:
                added = np.array(later.pop(rank))
                at = added if at is None else np.concatenate([at, added])
                at = np.unique(at)
            at = at[seen[at] == rank]
            while len(at):
                left = before[at]
                go = at[(seen[left] != rank) | (left == n)] if len(at) > 1 else at
                j = after[go]
                k = after[j]
                token[go], after[go], before[k] = rank, k, go
                before[n] = n
                seen[j], token[j] = -1, -2
                right = np.where(k < n, self.rank_of(np.full(len(go), rank), token[k]), -1)
                seen[go] = right
                h = before[go]
                inner = h < n
                h = h[inner]
                seen[h] = self.rank_of(token[h], np.full(len(h), rank))
                fresh = np.concatenate([go[right >= 0], h[seen[h] >= 0]])
                for r, p in zip(seen[fresh].tolist(), fresh.tolist()):
                    if r in later:
                        later[r].append(p)
                    else:
                        later[r] = [p]
                        words[r >> _WORD_BITS] |= 1 << (r & 255)
                        top |= 1 << (r >> _WORD_BITS)
                at = at[seen[at] == rank]
        alive = token[:n] >= 0
        counts = np.add.reduceat(alive, ends - lengths) * 4
        flat = token[:n][alive].astype("<i4").tobytes()
        stops = np.cumsum(counts).tolist()
        return [flat[a:b] for a, b in zip([0, *stops], stops)]


class Encoder(dict):
    """Pre-token -> little-endian int32 ids, filled as pre-tokens come up. Half of the entries are those
    of the time before; what comes up again moves over, the rest is forgotten at the next turn."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.before: dict[str, bytes] = {}
        self.queue, self.pattern, self.entries = RankQueue(ranks), regex.compile(pattern), entries
        self.many = BatchQueue(self.queue) if closed(self.queue) else None

    def __missing__(self, piece: str) -> bytes:
        return np.array(self.queue.encode(piece.encode()), dtype="<i4").tobytes()

    def learn(self, pieces: set[str]) -> None:
        """Remember the ids of the short pieces that are not known yet."""
        new = pieces.difference(self)
        if 2 * (len(self) + len(new)) > self.entries:
            self.before = dict(self)
            self.clear()
            new = pieces
        known = self.before
        if known:
            again = new.intersection(known)
            self.update(zip(again, map(known.__getitem__, again)))
            new = new.difference(again)
        new = [p for p in new if len(p) <= SHORT_CHARS]
        ranks, coded = self.queue.ranks, [p.encode() for p in new]
        rest = []
        for piece, raw in zip(new, coded):
            whole = ranks.get(raw)
            if whole is not None:
                self[piece] = whole.to_bytes(4, "little")
            elif self.many is None:
                self[piece] = np.array(self.queue.encode(raw), dtype="<i4").tobytes()
            else:
                rest.append((piece, raw))
        if rest:
            self.update(zip([p for p, _ in rest], self.many.encode([raw for _, raw in rest])))

    def forget(self) -> None:
        """Drops what was remembered; the prepared vocabulary stays."""
        self.clear()
        self.before = {}

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """ids of each text. Texts are taken together up to LIST_CHARS; a longer one goes in parts."""
        out: list[bytes] = []
        held: list[list[str]] = []
        size = 0

        def flush():
            self.learn(set(itertools.chain.from_iterable(held)))
            out.extend(b"".join(map(self.__getitem__, found)) for found in held)
            held.clear()

        for text in texts:
            if len(text) > LIST_CHARS:
                flush()
                size = 0
                found = (m.group() for m in self.pattern.finditer(text))
                parts = []
                while piece := list(itertools.islice(found, 200_000)):
                    self.learn(set(piece))
                    parts.append(b"".join(map(self.__getitem__, piece)))
                out.append(b"".join(parts))
                continue
            held.append(self.pattern.findall(text))
            size += len(text)
            if size > LIST_CHARS:
                flush()
                size = 0
        flush()
        return out


def closed(queue: RankQueue) -> bool:
    """Whether the bytes of every token are merged to that token."""
    ranks, queue.ranks = queue.ranks, {}
    try:
        return all(queue.encode(token) == [rank] for token, rank in ranks.items())
    finally:
        queue.ranks = ranks


_encoders: dict[tuple, Encoder] = {}


def encoder_of(ranks: dict[bytes, int], pattern: str) -> Encoder:
    """The worker's encoder: kept between tasks, so that the vocabulary is prepared once."""
    key = (len(ranks), hash(frozenset(ranks.items())), pattern)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(ranks, pattern)
    return _encoders[key]


def with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    at = batch.schema.get_field_index(name)
    if at >= 0:
        return batch.set_column(at, name, values)
    return batch.append_column(name, values)


def schema_with(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    fields = [T.StructField(name, kind) if f.name == name else f for f in schema.fields]
    return T.StructType(fields if name in schema.names else [*fields, T.StructField(name, kind)])


def list_array(parts: list[bytes]) -> pa.Array:
    """array<int> from the bytes of each row's int32 elements."""
    offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])])
    values = pa.array(np.frombuffer(b"".join(parts), dtype="<i4"))
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def pieces(batch: pa.RecordBatch, column: str, limit: int = 4 << 20):
    """The batch in slices of whole rows with at most ``limit`` bytes in ``column``, one row at least."""
    at = batch.schema.get_field_index(column)
    sizes = np.cumsum([0 if v is None else v for v in pc.binary_length(batch.column(at)).to_pylist()])
    row = 0
    while row < batch.num_rows:
        done = sizes[row - 1] if row else 0
        end = max(row + 1, int(np.searchsorted(sizes, done + limit, side="right")))
        yield batch.slice(row, end - row)
        row = end


def encoded_batches(batches, ranks: dict[bytes, int], pattern: str, text: str, out: str):
    """Batches with the ids of each text. What was remembered is dropped at the end, as idle workers
    would hold it."""
    encoder = encoder_of(ranks, pattern)
    try:
        for batch in batches:
            if not batch.num_rows:
                continue
            for part in pieces(batch, text):
                texts = part.column(part.schema.get_field_index(text)).to_pylist()
                yield with_column(part, out, list_array(encoder.encode_all([t or "" for t in texts])))
    finally:
        encoder.forget()


def byte_strings(ranks: dict[bytes, int]) -> pa.Array:
    """The bytes of each rank, null where there is none."""
    strings: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        strings[rank] = token
    return pa.array(strings, pa.binary())


def decoded_batches(batches, strings: pa.Array, ids: str, out: str):
    """Batches with the bytes of each array of ids: all tokens are taken at once, and the rows cut out of them."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(ids))
        counts = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
        row = 0
        while row < batch.num_rows:
            done = counts[row - 1] if row else 0
            end = max(row + 1, int(np.searchsorted(counts, done + DECODE_TOKENS, side="right")))
            flat = column.slice(row, end - row).flatten()
            if not len(flat):
                yield with_column(batch.slice(row, end - row), out, pa.array([b""] * (end - row), pa.binary()))
                row = end
                continue
            tokens = strings.take(flat)
            if tokens.null_count:
                raise ValueError("null or unknown token ids")
            cuts = np.concatenate([[0], counts[row:end] - done])
            at = np.frombuffer(tokens.buffers()[1], dtype=np.int32)[tokens.offset :][: len(tokens) + 1][cuts]
            rows = pa.BinaryArray.from_buffers(pa.binary(), end - row, [None, pa.py_buffer(at.copy()), tokens.buffers()[2]])
            yield with_column(batch.slice(row, end - row), out, rows)
            row = end


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """``docs`` with the array of token ids of each text; every match of ``pattern`` is merged by itself.

    The rank file is read on the driver and broadcast: its size is that of a vocabulary and doesn't
    depend on the data.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    return map_arrow(
        docs, lambda batches: encoded_batches(batches, shared.value, pattern, text, out), schema_with(docs.schema, out, T.ArrayType(T.IntegerType()))
    )


def decode(df: DataFrame, ranks_path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``df`` with the bytes that each array of token ids stands for."""
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    return map_arrow(df, lambda batches: decoded_batches(batches, byte_strings(shared.value), ids, out), schema_with(df.schema, out, T.BinaryType()))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``docs`` without the text, with its ids and what these decode to, in one Python worker a task."""
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    coded = schema_with(docs.schema, ids, T.ArrayType(T.IntegerType()))
    schema = schema_with(T.StructType([f for f in coded.fields if f.name != text]), out, T.BinaryType())

    def run(batches):
        done = (b.drop_columns([text]) for b in encoded_batches(batches, shared.value, pattern, text, ids))
        yield from decoded_batches(done, byte_strings(shared.value), ids, out)

    return map_arrow(docs, run, schema)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def default_ranks(spark: SparkSession) -> str:
    """Rank file of the public 50k byte-level vocabulary; ``spark.tallgram.bpe.ranks`` names another."""
    import public_tokenizers

    return spark.conf.get("spark.tallgram.bpe.ranks", public_tokenizers.path("byte_bpe_50k.tiktoken"))
