"""Many small states at once: those of very many keys as columns, merged and shrunk together.

An accumulator of its own for each key costs more than its numbers where there are millions of keys. The kernels
here do what ``kernels.merger`` does, for all runs of a sorted list of states by one step over arrays.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa

from .kernels import LINEAR, SHRINKING, Shrinking, Spec, merger

#: Numbers that one step over states of equal height works on.
STEP = 1 << 20
#: States a pool holds, and numbers of them, before it hands on what merging doesn't make fewer.
HELD, HELD_NUMBERS = 1 << 18, 1 << 23
#: States up to this many numbers are small: their bookkeeping costs more than their numbers.
SMALL = 256


@dataclass
class States:
    """Columns of states; ``data`` holds their numbers one after the other, ``cells`` of them for each."""

    m: np.ndarray
    n_rows: np.ndarray
    delta: np.ndarray
    delta_first: np.ndarray
    mass_lost: np.ndarray
    cells: np.ndarray
    data: np.ndarray

    def __len__(self) -> int:
        return len(self.m)

    def scalars(self) -> list[np.ndarray]:
        return [self.m, self.n_rows, self.delta, self.delta_first, self.mass_lost, self.cells]

    def take(self, order: np.ndarray) -> States:
        picked = [x[order] for x in self.scalars()]
        return States(*picked, self.data[spread((np.cumsum(self.cells) - self.cells)[order], picked[-1])])

    @staticmethod
    def joined(parts: list[States]) -> States:
        return parts[0] if len(parts) == 1 else States(*(np.concatenate([getattr(p, f.name) for p in parts]) for f in fields(States)))

    @staticmethod
    def of_rows(block: np.ndarray) -> States:
        """Each row as a state of its own."""
        n, m = block.shape
        zeros = np.zeros(n)
        return States(np.full(n, m), np.ones(n, np.int64), zeros, zeros, zeros, np.full(n, m), np.ascontiguousarray(block, dtype=np.float64).ravel())

    @staticmethod
    def of_batch(batch) -> States:
        """States of a batch with the columns of ``sketch.STATE``."""
        whole = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("m", "n_rows")]
        parts = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("delta", "delta_first", "mass_lost")]
        data = batch.column("data")
        return States(*whole, *parts, np.diff(data.offsets.to_numpy()).astype(np.int64), data.flatten().to_numpy(zero_copy_only=False))

    def lists(self) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(self.cells)), pa.int32()), pa.array(self.data, pa.float64()))


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of stretches that begin at ``starts`` and are ``sizes`` long."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def coded(keys) -> np.ndarray:
    """Numbers that are equal where the keys are; a null key is a key of its own."""
    keys = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
    return keys.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)


def run_heads(*columns: np.ndarray) -> np.ndarray:
    """Where runs of rows that agree in all columns begin."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    differ = np.zeros(len(columns[0]), bool)
    differ[0] = True
    for c in columns:
        differ[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(differ)


def together(spec: Spec) -> bool:
    """Whether states of the spec can be merged by steps over arrays."""
    if spec.kind in LINEAR:
        return True
    if spec.kind not in SHRINKING or spec.kind == "dynamic_fd":
        return False
    kernel = merger(spec, spec.l)
    return type(kernel) is Shrinking and kernel.spec.strategy == "gram"


def merged(states: States, heads: np.ndarray, spec: Spec, final: bool = False) -> States:
    """One state of each run of states that begins at ``heads``, as ``merger`` makes it of them."""
    if not len(heads):
        return states
    counts = np.diff(heads, append=len(states))
    width = states.m[heads]
    clash = np.flatnonzero(np.repeat(width, counts) != states.m)
    if len(clash):
        raise ValueError(f"vectors of width {states.m[clash[0]]} and {np.repeat(width, counts)[clash[0]]} in one matrix")
    if not together(spec):
        return _one_by_one(states, heads, counts, spec, final)
    out = States(width, *(np.add.reduceat(x, heads) for x in states.scalars()[1:]), states.data)
    if spec.kind in LINEAR:
        return _added(states, heads, counts, out)
    parts, start = [states.data], np.cumsum(out.cells) - out.cells
    for m in np.unique(width).tolist():
        kernel = merger(spec, m)
        own, room = kernel.spec, len(kernel.buffer)
        least = min(own.l + 1, own.final_rows) if final else own.l + 1
        todo = np.flatnonzero((width == m) & (out.cells >= least * m))
        while len(todo):
            whole, parts = np.concatenate(parts), []
            parts.append(whole)
            at, rows = len(whole), out.cells[todo] // m
            for size in np.unique(np.minimum(rows, room)).tolist():
                same = todo[np.minimum(rows, room) == size]
                for k in range(0, len(same), max(STEP // (size * m), 1)):
                    chosen = same[k : k + max(STEP // (size * m), 1)]
                    x = whole[(start[chosen][:, None] + np.arange(size * m)).ravel()].reshape(-1, size, m)
                    kept, height, cut, lost = _shrunk(x, own)
                    out.delta[chosen] += cut
                    out.mass_lost[chosen] += lost
                    rest = out.cells[chosen] - size * m
                    if rest.any():  # rows beyond the buffer follow
                        kept = np.split(kept, np.cumsum(height * m)[:-1])
                        tails = [whole[s + size * m : s + size * m + n] for s, n in zip(start[chosen], rest)]
                        kept = np.concatenate([x for pair in zip(kept, tails) for x in pair])
                    cells = height * m + rest
                    start[chosen] = at + np.cumsum(cells) - cells
                    out.cells[chosen] = cells
                    at += len(kept)
                    parts.append(kept)
            more = todo[rows > room]
            todo = more[out.cells[more] >= least * m]
    if len(parts) > 1:
        out.data = np.concatenate(parts)[spread(start, out.cells)]
    return out


def _shrunk(x: np.ndarray, spec: Spec):
    """``Shrinking.shrink`` of many buffers of equal height: the rows that are left, one buffer after the other,
    how many each has, what was subtracted and the mass lost."""
    l = spec.l
    before = np.einsum("bij,bij->b", x, x)
    if x.shape[1] <= x.shape[2]:
        squares, u = np.linalg.eigh(x @ x.transpose(0, 2, 1))
        squares = np.maximum(squares[:, ::-1], 0.0)
        kept = u[:, :, ::-1].transpose(0, 2, 1)[:, :l] @ x
    else:
        squares, v = np.linalg.eigh(x.transpose(0, 2, 1) @ x)
        squares = np.maximum(squares[:, ::-1], 0.0)
        kept = (np.sqrt(squares)[:, :, None] * v[:, :, ::-1].transpose(0, 2, 1))[:, :l]
    cut = squares[:, spec.cut] if spec.cut < squares.shape[1] else np.zeros(len(x))
    target = np.where(np.arange(squares.shape[1]) < spec.spared, squares, np.maximum(squares - cut[:, None], 0.0))
    scale = np.sqrt(np.divide(target, squares, out=np.zeros_like(target), where=squares > 0))
    rows = kept * scale[:, :l, None]
    good = target[:, :l] > 0
    rows = rows[good]
    height = good.sum(axis=1)
    mass = np.bincount(np.repeat(np.arange(len(x)), height), weights=np.einsum("ij,ij->i", rows, rows), minlength=len(x))
    return rows.ravel(), height, cut, before - mass


def _added(states: States, heads, counts, out: States) -> States:
    """Linear states add up."""
    zeros = np.zeros(len(out))
    out.delta, out.delta_first, out.cells = zeros, zeros, states.cells[heads]
    if len(heads) == len(states):
        return out
    pieces, back = [], []
    for size in np.unique(out.cells).tolist():
        runs = np.flatnonzero(out.cells == size)
        data = states.data if len(runs) == len(heads) else states.take(spread(heads[runs], counts[runs])).data
        pieces.append(np.add.reduceat(data.reshape(-1, size), np.cumsum(counts[runs]) - counts[runs], axis=0).ravel())
        back.append(runs)
    order = np.concatenate(back)
    start = np.empty(len(out), np.int64)
    start[order] = np.cumsum(out.cells[order]) - out.cells[order]
    out.data = np.concatenate(pieces)[spread(start, out.cells)] if len(pieces) > 1 else pieces[0]
    return out


def _one_by_one(states: States, heads, counts, spec: Spec, final: bool) -> States:
    ends = np.cumsum(states.cells)
    rows, data = [], []
    for head, count in zip(heads.tolist(), counts.tolist()):
        acc = merger(spec, int(states.m[head]))
        for n in range(head, head + count):
            acc.merge(dict(
                n_rows=int(states.n_rows[n]), delta=float(states.delta[n]), delta_first=float(states.delta_first[n]),
                mass_lost=float(states.mass_lost[n]), data=states.data[ends[n] - states.cells[n] : ends[n]],
            ))
        state = acc.state(final)
        data.append(np.array(state["data"], dtype=np.float64))
        rows.append([state[c] for c in ("m", "n_rows", "delta", "delta_first", "mass_lost")] + [len(data[-1])])
    kinds = (np.int64, np.int64, np.float64, np.float64, np.float64, np.int64)
    return States(*(np.array(c, dtype=k) for c, k in zip(zip(*rows), kinds)), np.concatenate(data))


class Pool:
    """States that one task gathers, by key and a whole number; equal ones are merged when many are held, and handed
    on when that leaves many. ``lows`` and ``highs`` are carried along as the least and the greatest of each."""

    def __init__(self, spec: Spec, most: int = HELD):
        self.spec, self.most = spec, most
        self.held: list[tuple] = []
        self.size, self.numbers = 0, 0

    def add(self, keys, by: np.ndarray, lows: list[np.ndarray], highs: list[np.ndarray], states: States):
        """Yields (keys, by, lows, highs, states) that are handed on."""
        self.held.append((keys, by, lows, highs, states))
        self.size += len(states)
        self.numbers += len(states.data)
        if self.size >= self.most or self.numbers >= HELD_NUMBERS:
            found = self._merged()
            self.held, self.size, self.numbers = [found], len(found[-1]), len(found[-1].data)
            if self.size > self.most // 2 or self.numbers > HELD_NUMBERS // 2:
                self.held, self.size, self.numbers = [], 0, 0
                yield found

    def rest(self):
        if self.held:
            yield self._merged()
            self.held, self.size, self.numbers = [], 0, 0

    def _merged(self) -> tuple:
        keys = pa.chunked_array([h[0] for h in self.held], pa.string()).combine_chunks()
        keys = pa.concat_arrays(keys.chunks) if isinstance(keys, pa.ChunkedArray) else keys
        codes, by = coded(keys), np.concatenate([h[1] for h in self.held])
        lows, highs = ([np.concatenate(c) for c in zip(*(h[n] for h in self.held))] for n in (2, 3))
        order = np.lexsort((by, codes))
        heads = run_heads(codes[order], by[order])
        states = merged(States.joined([h[4] for h in self.held]).take(order), heads, self.spec)
        first = order[heads]
        return (
            keys.take(pa.array(first)), by[first], [np.minimum.reduceat(x[order], heads) for x in lows],
            [np.maximum.reduceat(x[order], heads) for x in highs], states,
        )
