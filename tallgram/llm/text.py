"""Word and window hashes of Arrow text columns, computed on the UTF-8 bytes with NumPy.

A text column is worked through in slices of whole texts of a few megabytes. Words are maximal runs
of bytes of one kind; all bytes beyond ASCII are of one kind, so runs never cut a character. A word's hash
is a polynomial over its bytes modulo 2^64, taken from prefix sums and finished with an invertible
mixer; a window's hash is a polynomial over the hashes of its words in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
#: Bytes of texts worked on at once; a longer text is a slice of its own.
SLICE_BYTES = 2 << 20
#: Bytes of one hashing step, so that the 8-byte arrays stay small inside very long texts too.
STEP_BYTES = 1 << 20

_BYTE_BASE = 0x9E3779B97F4A7C15 | 1
_WORD_BASES = (0xD6E8FEB86659FD93 | 1, 0xA0761D6478BD642F | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^k and base^-k modulo 2^64 for k below n at least."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = max(n, 1 << 16)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            factors = np.full(size, b, dtype=np.uint64)
            factors[0] = 1
            both.append(np.cumprod(factors, dtype=np.uint64))
        _powers[base] = (both[0], both[1])
    return _powers[base]


def separators(blanks: bytes = BLANKS) -> np.ndarray:
    """Kind of each byte: 0 for the given separators, 1 for all others."""
    table = np.ones(256, dtype=np.uint8)
    table[np.frombuffer(blanks, dtype=np.uint8)] = 0
    return table


def words_and_marks() -> np.ndarray:
    """Kind of each byte: 0 blanks and control bytes, 1 letters, digits and all beyond ASCII, 2 other marks."""
    table = np.full(256, 2, dtype=np.uint8)
    table[:33] = 0
    table[127] = 0
    for low, high in ((48, 58), (65, 91), (97, 123), (128, 256)):
        table[low:high] = 1
    return table


def lower_ascii() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


class Words(NamedTuple):
    """Words of the texts of one slice, in order."""

    first: int  #: row of the slice's first text
    counts: np.ndarray  #: words of each text
    starts: np.ndarray  #: byte position in ``data`` of each word
    ends: np.ndarray
    hashes: np.ndarray  #: uint64
    data: np.ndarray  #: bytes of the slice's texts
    offsets: np.ndarray  #: byte position of each text, and the end

    @property
    def text_starts(self) -> np.ndarray:
        """Number of the first word of each text, and the number of words."""
        return np.concatenate([[0], np.cumsum(self.counts)])


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words_of(first: int, data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray, fold: np.ndarray | None = None) -> Words:
    """Words of one slice: runs of bytes of one kind other than 0. ``fold`` maps bytes before hashing."""
    kind = kinds[data]
    opens = kind > 0
    closes = opens.copy()
    change = kind[1:] != kind[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]  # a text starts a word, and ends that of the text before
    change[heads[heads > 0] - 1] = True
    opens[1:] &= change
    closes[:-1] &= change
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    hashes = np.empty(len(starts), dtype=np.uint64)
    word = 0
    while word < len(starts):
        stop = max(word + 1, int(np.searchsorted(ends, starts[word] + STEP_BYTES, side="right")))
        low, high = int(starts[word]), int(ends[stop - 1])
        part = data[low:high] if fold is None else fold[data[low:high]]
        up, down = powers(_BYTE_BASE, high - low + 1)
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE_VALUES[part] * up[: high - low], dtype=np.uint64)])
        s, e = starts[word:stop] - low, ends[word:stop] - low
        hashes[word:stop] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        word = stop
    counts = np.diff(np.searchsorted(starts, offsets))
    return Words(first, counts, starts, ends, hashes, data, offsets)


def each_slice(column: pa.Array, kinds: np.ndarray, fold: np.ndarray | None = None) -> Iterator[Words]:
    for first, data, offsets in text_slices(column):
        yield words_of(first, data, offsets, kinds, fold)


def window_hashes(words: np.ndarray, length: int, variant: int = 0) -> np.ndarray:
    """Hash of the window of ``length`` words from each word on, whatever text they belong to;
    empty if there are fewer words. The two variants are independent functions."""
    n = len(words)
    if n < length:
        return np.zeros(0, dtype=np.uint64)
    base = _WORD_BASES[variant]
    up, down = powers(base, n + 1)
    values = words if variant == 0 else mix(words ^ np.uint64(0x5851F42D4C957F2D))
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values * up[:n], dtype=np.uint64)])
    return mix((sums[length:] - sums[:-length]) * down[: n - length + 1] + np.uint64(length))


def window_text(text_starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers at which a window of ``length`` words lies in one text, and the text of each."""
    counts = np.diff(text_starts)
    windows = np.maximum(counts - length + 1, 0)
    text = np.repeat(np.arange(len(counts)), windows)
    begin = np.cumsum(windows) - windows
    number = np.arange(int(windows.sum())) - begin[text] + text_starts[:-1][text]
    return number, text


def fingerprints(words: Words) -> np.ndarray:
    """Per text the two 64-bit hashes of its whole word sequence, shape (texts, 2)."""
    starts = words.text_starts
    out = np.zeros((len(words.counts), 2), dtype=np.uint64)
    for variant, base in enumerate(_WORD_BASES):
        n = len(words.hashes)
        up, down = powers(base, n + 1)
        values = words.hashes if variant == 0 else mix(words.hashes ^ np.uint64(0x5851F42D4C957F2D))
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values * up[:n], dtype=np.uint64)])
        out[:, variant] = mix((sums[starts[1:]] - sums[starts[:-1]]) * down[starts[:-1]] + words.counts.astype(np.uint64))
    return out
