"""Distributed sketches: one narrow pass over the data, then rounds of merges of small states.

The pass works on the partitions the scan delivers, without a shuffle of the rows; each task keeps
one accumulator per (key, grid point), the way a map-side hash aggregate does, and hands over
states of at most l x m numbers. A hot key therefore costs one state per task, not a shuffle of its
rows. Merge rounds combine ``FAN_IN`` states at a time, streaming over sorted states.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..layouts import dense_block
from ..session import check_bytes, expected_partitions, map_arrow, matrix_budget
from .algebra import bucketize
from .kernels import LINEAR, SHRINKING, Spec, accumulator, merger
from .many import SMALL, Pool, States, coded, merged, run_heads, spread, together

STATE = (
    "key string, grid_id int, phase int, part int, kind string, l int, b int, alpha double, m int, "
    "filled int, n_rows bigint, delta double, delta_first double, mass_lost double, "
    "mark bigint, data array<double>"
)
FAN_IN = 64
LIVE_BYTES = 512 << 20
#: Keys of a batch from which on, where there are as many as a sixteenth of its rows, they are condensed together.
MANY_KEYS = 64
#: Mark of a state that has none.
LATEST = np.iinfo(np.int64).min
#: Bytes of rows that one task of a reproducible split should read.
PIECE_BYTES = 32 << 20

_ARROW = pa.schema(
    [
        ("key", pa.string()),
        ("grid_id", pa.int32()),
        ("phase", pa.int32()),
        ("part", pa.int32()),
        ("kind", pa.string()),
        ("l", pa.int32()),
        ("b", pa.int32()),
        ("alpha", pa.float64()),
        ("m", pa.int32()),
        ("filled", pa.int32()),
        ("n_rows", pa.int64()),
        ("delta", pa.float64()),
        ("delta_first", pa.float64()),
        ("mass_lost", pa.float64()),
        ("mark", pa.int64()),
        ("data", pa.list_(pa.float64())),
    ]
)


def state_batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {
            f.name: pa.array([r[f.name] for r in rows], f.type)
            for f in _ARROW
        },
        schema=_ARROW,
    )


def state_batches(rows):
    """Small states together, as there may be one for each of very many keys."""
    held, numbers = [], 0
    for row in rows:
        held.append(row)
        numbers += len(row["data"])
        if len(held) == 1024 or numbers >= 1 << 17:
            yield state_batch(held)
            held, numbers = [], 0
    if held:
        yield state_batch(held)


def _labelled(acc, spec: Spec, key, phase: int, part: int, final: bool = False) -> dict:
    own = acc.spec
    return acc.state(final) | dict(
        key=key, grid_id=spec.grid_id, phase=phase, part=part, kind=spec.kind, l=own.l,
        b=spec.extra, alpha=spec.alpha, mark=acc.mark,
    )


def labelled_batch(keys, spec: Spec, phase: int, part, states: States, mark=None) -> pa.RecordBatch:
    """States as rows of STATE; ``part`` is a number or one for each, ``mark`` has LATEST where there is none."""
    n = len(states)
    l = spec.l2 if spec.kind == "dynamic_fd" and phase != 1 else spec.l
    height = states.cells // np.maximum(states.m, 1)
    if spec.kind in LINEAR:
        height = states.m if spec.kind == "gram" else np.full(n, l)
    same = dict(grid_id=spec.grid_id, phase=phase, kind=spec.kind, l=l, b=spec.extra, alpha=spec.alpha)
    columns = {name: pa.repeat(pa.scalar(x, _ARROW.field(name).type), n) for name, x in same.items()}
    columns |= dict(
        key=pa.nulls(n, pa.string()) if keys is None else keys, part=np.full(n, part) if np.isscalar(part) else part, m=states.m, filled=height,
        n_rows=states.n_rows, delta=states.delta, delta_first=states.delta_first, mass_lost=states.mass_lost, data=states.lists(),
        mark=pa.nulls(n, pa.int64()) if mark is None else pa.array(mark, pa.int64(), mask=mark == LATEST),
    )
    arrays = [x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in ((columns[f.name], f) for f in _ARROW)]
    return pa.RecordBatch.from_arrays(arrays, schema=_ARROW)


def _in_parts(keys, spec: Spec, phase: int, part: np.ndarray, states: States, mark=None):
    """The same in batches of few numbers."""
    edges = np.append(run_heads(np.arange(len(states)) // 8192, np.cumsum(states.cells) >> 17), len(states))
    ends = np.append(0, np.cumsum(states.cells))
    for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
        some = States(*(x[low:high] for x in states.scalars()), states.data[ends[low] : ends[high]])
        yield labelled_batch(keys.slice(low, high - low), spec, phase, part[low:high], some, None if mark is None else mark[low:high])


def _groups(keys):
    """(key, positions) per distinct key of a batch; one group when there is no key column."""
    if keys is None:
        yield None, slice(None)
        return
    encoded = keys.dictionary_encode()
    codes = encoded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    edges = np.flatnonzero(np.diff(codes[order])) + 1
    names = encoded.dictionary.to_pylist()
    for positions in np.split(order, edges):
        code = codes[positions[0]]
        yield (None if code < 0 else names[code]), positions


def _phases(spec: Spec, row_ids: np.ndarray):
    """(phase, mask): rows before the change point belong to phase 1 of a dynamic sketch."""
    if spec.kind != "dynamic_fd":
        yield 2, None
        return
    early = row_ids < spec.change_at
    if early.any():
        yield 1, early
    if not early.all():
        yield 2, ~early


def _absorb(batches, specs: tuple[Spec, ...], aux: dict, m: int | None, live_bytes: int, budget: int):
    """Accumulate the batches of one task and yield its states, one for each bucket it has rows of."""
    task = TaskContext.get()
    live: OrderedDict = OrderedDict()
    held = 0
    pools = {spec: Pool(spec) for spec in specs} if all(map(_pooled, specs)) else {}
    for part, batch in _by_bucket(batches, task.partitionId() if task else 0):
        columns = batch.schema.names
        if pools and "key" in columns and "vec" in columns and _many_keys(batch.column("key")):
            yield from _pool(pools, part, batch, budget)
            continue
        ids = batch.column("row_id").to_numpy(zero_copy_only=False)
        marks = batch.column("mark").to_numpy(zero_copy_only=False) if "mark" in columns else None
        sparse = "idx" in columns
        if sparse:
            idx_column = batch.column("idx")
            sizes = np.diff(idx_column.offsets.to_numpy())
            if idx_column.flatten().null_count:
                raise ValueError("null column numbers in the matrix")
            idx = idx_column.flatten().to_numpy()
            val = batch.column("val").flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
            check_sparse(batch.column("idx"), batch.column("val"), idx, val, m)
            width = m
        else:
            block = dense_block(batch.column("vec"))
            width = block.shape[1]
        for key, rows in _groups(batch.column("key") if "key" in columns else None):
            for spec in specs:
                own_ids = ids[rows]
                for phase, mask in _phases(spec, own_ids):
                    name = (key, spec.grid_id, phase, part)
                    acc = live.get(name)
                    if acc is None:
                        check_bytes(spec.state_bytes(width), f"a {spec.kind} state", budget)
                        acc = live[name] = accumulator(spec, width, phase, aux.get(spec.grid_id))
                        acc.mark = None
                        held += _size(acc)
                    else:
                        live.move_to_end(name)
                    if marks is not None:
                        acc.mark = latest(acc.mark, int(marks[rows].max()))
                    if acc.m != width:
                        raise ValueError(f"vectors of width {width} and {acc.m} in one matrix")
                    if sparse:
                        chosen = np.arange(len(ids))[rows]
                        chosen = chosen if mask is None else chosen[mask]
                        _add_sparse(acc, chosen, ids, sizes, idx, val)
                    else:
                        part_block = block[rows]
                        if mask is None:
                            acc.add(part_block, own_ids)
                        else:
                            acc.add(part_block[mask], own_ids[mask])
            while held > live_bytes and len(live) > len(specs):
                old, acc = live.popitem(last=False)
                held -= _size(acc)
                yield state_batch([_labelled(acc, _spec(specs, old[1]), old[0], old[2], old[3])])
    yield from state_batches(
        _labelled(acc, _spec(specs, grid_id), key, phase, part) for (key, grid_id, phase, part), acc in live.items()
    )
    for spec, pool in pools.items():
        for keys, parts, _, (mark,), states in pool.rest():
            yield from _in_parts(keys, spec, 2, parts, states, mark)


def _pooled(spec: Spec) -> bool:
    return spec.kind == "gram" or (spec.kind in SHRINKING and not spec.kind.startswith("sparse") and together(spec))


def _many_keys(keys) -> bool:
    distinct = len(keys.dictionary_encode().dictionary)
    return distinct >= MANY_KEYS and distinct * 16 >= len(keys)


def _pool(pools: dict, part: int, batch, budget: int):
    """Rows of a batch in which most keys have few: added up by key at once, not one key after the other."""
    block = dense_block(batch.column("vec"))
    n, m = block.shape
    by = np.full(n, part)
    marks = np.full(n, LATEST)
    if "mark" in batch.schema.names:
        marks = batch.column("mark").to_numpy(zero_copy_only=False).astype(np.int64)
    for spec, pool in pools.items():
        check_bytes(spec.state_bytes(m), f"a {spec.kind} state", budget)
        if spec.kind == "gram":
            order = np.argsort(coded(batch.column("key")), kind="stable")
            heads = run_heads(coded(batch.column("key"))[order])
            step = max((1 << 20) // (m * m), 1)
            products = np.zeros((len(heads), m, m))
            run = np.repeat(np.arange(len(heads)), np.diff(heads, append=n))
            for at in range(0, n, step):
                some = order[at : at + step]
                own = run[at : at + step]
                cuts = run_heads(own)
                products[own[cuts]] += np.add.reduceat(block[some][:, :, None] * block[some][:, None, :], cuts, axis=0)
            square = np.add.reduceat(np.einsum("ij,ij->i", block, block)[order], heads)
            zeros = np.zeros(len(heads))
            states = States(np.full(len(heads), m), np.diff(heads, append=n), zeros, zeros, square, np.full(len(heads), m * m), products.ravel())
            found = pool.add(batch.column("key").take(pa.array(order[heads])), by[heads], [], [np.maximum.reduceat(marks[order], heads)], states)
        else:
            found = pool.add(batch.column("key"), by, [], [marks], States.of_rows(block))
        for keys, parts, _, (mark,), states in found:
            yield from _in_parts(keys, spec, 2, parts, states, mark)


def _by_bucket(batches, partition: int):
    """(part, batch): slices of one bucket where there is a bucket column (sorted), else whole batches."""
    for batch in batches:
        if not batch.num_rows:
            continue
        if "bucket" not in batch.schema.names:
            yield partition, batch
            continue
        bucket = batch.column("bucket").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
        for low, high in zip(cuts, cuts[1:]):
            yield int(bucket[low]), batch.slice(low, high - low)


def check_sparse(idx_column, val_column, idx: np.ndarray, val: np.ndarray, m: int) -> None:
    """Sparse rows hold as many finite values as column numbers, all of these within the matrix."""
    if idx_column.null_count or val_column.null_count:
        raise ValueError("null rows of column numbers or values in the matrix")
    if (np.diff(idx_column.offsets.to_numpy()) != np.diff(val_column.offsets.to_numpy())).any():
        raise ValueError("sparse rows with more column numbers than values, or fewer")
    if not np.isfinite(val).all():
        raise ValueError("null, NaN or infinite elements in the matrix")
    if len(idx) and (idx.min() < 0 or idx.max() >= m):
        raise ValueError(f"column numbers {idx.min()} to {idx.max()} in a matrix of {m} columns")


def latest(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else max(a, b)


def _size(acc) -> int:
    return acc.buffer.nbytes if hasattr(acc, "buffer") else acc.total.nbytes


def _spec(specs, grid_id: int) -> Spec:
    return next(s for s in specs if s.grid_id == grid_id)


def _add_sparse(acc, chosen, ids, sizes, idx, val) -> None:
    if len(chosen) < len(ids):
        ends = np.cumsum(sizes)
        take = np.concatenate([np.arange(ends[r] - sizes[r], ends[r]) for r in chosen])
        idx, val, sizes, ids = idx[take], val[take], sizes[chosen], ids[chosen]
    if hasattr(acc, "add_sparse"):
        acc.add_sparse(sizes, idx, val)
    elif hasattr(acc, "add_sparse_rows"):
        acc.add_sparse_rows(ids, sizes, idx, val)
    else:
        for start in range(0, len(sizes), 1024):
            size = sizes[start : start + 1024]
            lo = int(sizes[:start].sum())
            block = np.zeros((len(size), acc.m))
            rows = np.repeat(np.arange(len(size)), size)
            block[rows, idx[lo : lo + len(rows)]] = val[lo : lo + len(rows)]
            acc.add(block, ids[start : start + 1024])


def _state_rows(batches):
    for batch in batches:
        data = batch.column("data")
        offsets, values = data.offsets.to_numpy(), data.values.to_numpy(zero_copy_only=False)
        small = batch.drop_columns(["data"]).to_pylist()
        for n, row in enumerate(small):
            row["data"] = values[offsets[n] : offsets[n + 1]]
            yield row


def _combine(batches, specs, final: bool, strict: bool):
    if not all(map(together, specs)):
        return state_batches(_combined(batches, specs, final, strict))
    first = next((batch for batch in batches if batch.num_rows), None)
    if first is None:
        return iter(())
    batches = chain([first], batches)
    if len(first.column("data").flatten()) > SMALL * first.num_rows:
        return state_batches(_combined(batches, specs, final, strict))
    return _combined_many(batches, specs, final, strict)


def _combined_many(batches, specs, final: bool, strict: bool):
    """``_combined`` for states of few numbers: all runs that end in a batch by one step over arrays."""

    def done(keys, grid, part, phase, mark, states, heads):
        counts = np.diff(heads, append=len(states))
        for spec in specs:
            own = np.flatnonzero(grid[heads] == spec.grid_id)
            if not len(own):
                continue
            first = heads[own]
            starts = np.cumsum(counts[own]) - counts[own]
            some = states if len(own) == len(heads) else states.take(spread(first, counts[own]))
            row = merged(some, starts, spec, final)
            marks = np.maximum.reduceat(mark, heads)[own]
            if final and strict and spec.kind in SHRINKING and (row.n_rows < spec.l).any():
                raise ValueError(f"l={spec.l} exceeds the {row.n_rows[row.n_rows < spec.l][0]} rows")
            names, parts = keys.take(pa.array(first)), np.zeros(len(own), np.int64) if final else part[first]
            if final:
                yield from _in_parts(names, spec, 0, parts, row, marks)
                continue
            for value in np.unique(phase[first]).tolist():
                at = np.flatnonzero(phase[first] == value)
                yield from _in_parts(names.take(pa.array(at)), spec, value, parts[at], row.take(at), marks[at])

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        numbers = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("grid_id", "part", "phase")]
        mark = batch.column("mark").fill_null(LATEST).to_numpy(zero_copy_only=False)
        here = [batch.column("key"), *numbers, mark, States.of_batch(batch)]
        if held is not None:
            here = [pa.concat_arrays([held[0], here[0]]), *(np.concatenate(x) for x in zip(held[1:5], here[1:5])), States.joined([held[5], here[5]])]
        heads = run_heads(coded(here[0]), *here[1:4])
        low = int(heads[-1])
        if low:
            yield from done(here[0].slice(0, low), *(x[:low] for x in here[1:5]), here[5].take(np.arange(low)), heads[:-1])
        rest = np.arange(low, len(here[1]))
        open_run = merged(here[5].take(rest), np.zeros(1, np.int64), _spec(specs, int(here[1][low])))
        held = [here[0].slice(low, 1), *(x[low : low + 1] for x in here[1:4]), here[4][low:].max(keepdims=True), open_run]
    yield from done(*held, np.zeros(1, np.int64))


def _combined(batches, specs, final: bool, strict: bool):
    """Merge runs of states sorted by (key, grid_id, part, phase)."""
    current, acc = None, None
    first = None  # finished phase 1 of a dynamic sketch

    def alone():
        """A phase 1 that no row followed is the group's result."""
        nonlocal first
        if first is None:
            return []
        row, first = first, None
        if strict:
            raise ValueError("the change point lies beyond the last row")
        return [row]

    def done():
        nonlocal first
        key, grid_id, part, phase = current
        spec = _spec(specs, grid_id)
        if not final:
            return [_labelled(acc, spec, key, phase, part)]
        if spec.kind == "dynamic_fd" and phase == 1:
            before = alone()
            first = _labelled(acc, spec, key, 0, 0, True)
            first["delta_first"] = first["delta"]
            return before
        before = []
        if first is not None and (first["key"], first["grid_id"]) == (key, grid_id):
            acc.merge(first)
            acc.mark = latest(acc.mark, first["mark"]) if first["mark"] is not None else acc.mark
            first = None
        else:
            before = alone()
        row = _labelled(acc, spec, key, 0, 0, True)
        if strict and spec.kind in SHRINKING:
            if row["n_rows"] < row["l"]:
                raise ValueError(f"l={row['l']} exceeds the {row['n_rows']} rows")
            if spec.kind == "dynamic_fd" and spec.change_at >= row["n_rows"]:
                raise ValueError("the change point lies beyond the last row")
        return [*before, row]

    for row in _state_rows(batches):
        name = (row["key"], row["grid_id"], row["part"], row["phase"])
        if name != current:
            if acc is not None:
                for ready in done():
                    yield ready
            spec = _spec(specs, row["grid_id"])
            current = name
            acc = merger(spec, row["m"], row["phase"])
            acc.mark = None
        if row["m"] != acc.m:
            raise ValueError(f"vectors of width {row['m']} and {acc.m} in one matrix")
        acc.merge(row)
        acc.mark = latest(acc.mark, row["mark"])
    if acc is not None:
        for ready in done():
            yield ready
    for ready in alone():
        yield ready


def partial_states(
    matrix: DataFrame,
    specs,
    key: str | None = None,
    m: int | None = None,
    aux: dict | None = None,
    tasks: int | None = None,
    buckets: int | None = None,
    starts: list[int] | None = None,
    pieces: int = 1,
) -> DataFrame:
    """States of the rows each task reads. ``matrix`` is in row layout or, with ``m`` given, in
    sparse-row layout; ``key`` names a column that splits it into independent matrices.

    A ``mark`` column (BIGINT) is carried along as the largest value each state has seen.

    ``buckets`` asks for a reproducible split instead of the scan's own: rows are dealt to that many
    buckets by a 64-bit hash of id and content and sorted by id and hash, so results do not depend on file
    layout even where ids repeat. ``starts`` (first row ids, as of ``ranges.balanced_starts``) deals
    them to ranges of ids instead. A bucket or range is dealt to ``pieces`` parts by a second hash of its rows,
    see ``split_pieces``.
    """
    specs = tuple(s.check() for s in specs)
    if len({s.grid_id for s in specs}) != len(specs):
        raise ValueError("grid_id must be unique among the specs")
    if m is not None:
        for spec in specs:
            check_bytes(spec.state_bytes(m), f"a {spec.kind} state")
    sparse = "idx" in matrix.columns
    if sparse and m is None:
        raise ValueError("sparse rows need the number of columns m")
    columns = ["row_id", "idx", "val"] if sparse else ["row_id", "vec"]
    columns += ["mark"] if "mark" in matrix.columns else []
    picked = matrix.select(*columns, *([F.col(key).cast("string").alias("key")] if key else []))
    if buckets or starts:
        picked = picked.withColumn("content", F.xxhash64(*columns[: 3 if sparse else 2]))
        if starts:
            picked = bucketize(picked, "row_id", starts)
        else:
            picked = picked.withColumn("bucket", F.pmod("content", F.lit(buckets)).cast("int"))
        if pieces > 1:
            piece = F.pmod(F.xxhash64("content"), F.lit(pieces)).cast("int")
            picked = picked.withColumn("bucket", F.col("bucket") * pieces + piece)
        picked = picked.repartition((len(starts) if starts else buckets) * pieces, "bucket")
        picked = picked.sortWithinPartitions("bucket", "row_id", "content").drop("content")
    else:
        picked = picked.coalesce(tasks) if tasks else picked
    aux, budget = aux or {}, matrix_budget()
    return map_arrow(picked, lambda batches: _absorb(batches, specs, aux, m, LIVE_BYTES, budget), STATE)


def split_pieces(matrix: DataFrame, parts: int, fan_in: int) -> int:
    """Pieces of each of ``parts`` buckets that hold about ``PIECE_BYTES`` of rows: a power of ``fan_in``, so that
    the first rounds of merges put buckets together again. It follows from the rows alone, not from their files."""
    cells = F.greatest(F.size("idx"), F.lit(0)) * 12 if "idx" in matrix.columns else F.greatest(F.size("vec"), F.lit(0)) * 8
    held = matrix.agg(F.sum(F.coalesce(cells, F.lit(0)).cast("long") + 48)).first()[0] or 0
    pieces = 1
    while held > parts * pieces * PIECE_BYTES:
        pieces *= fan_in
    return pieces


def merge_states(
    states: DataFrame,
    specs,
    at_most: int,
    fan_in: int = FAN_IN,
    strict: bool = False,
    final: bool = True,
) -> DataFrame:
    """One final state per (key, grid_id). ``at_most`` parts of each are expected, which sets the
    number of rounds; if there are more, the last round merges more of them at a time."""
    specs = tuple(specs)
    rounds = max(1, math.ceil(math.log(max(at_most, 2), fan_in)))
    for number in range(rounds):
        last = number == rounds - 1
        group = F.lit(0) if last else F.floor(F.col("part") / fan_in).cast("int")
        grouped = states.withColumn("source", F.col("part")).withColumn("part", group)
        grouped = grouped.repartition("key", "grid_id", "part").sortWithinPartitions(
            "key", "grid_id", "part", "phase", "source"
        )
        done = last and final
        states = map_arrow(
            grouped.drop("source"),
            lambda batches, done=done: _combine(batches, specs, done, strict),
            STATE,
        )
    return states


def sketch(
    matrix: DataFrame,
    specs,
    key: str | None = None,
    m: int | None = None,
    aux: dict | None = None,
    tasks: int | None = None,
    buckets: int | None = None,
    fan_in: int = FAN_IN,
    strict: bool | None = None,
    starts: list[int] | None = None,
) -> DataFrame:
    """All ``specs`` of ``matrix`` in one pass; one state row per (key, grid_id).

    ``strict`` (default: on without a key) refuses a matrix with fewer rows than l.
    """
    specs = [specs] if isinstance(specs, Spec) else list(specs)
    parts, pieces = len(starts or []) or buckets, 1
    if parts:
        pieces = split_pieces(matrix, parts, fan_in)
    limit = parts * pieces if parts else tasks or expected_partitions(matrix)
    states = partial_states(matrix, specs, key, m, aux, tasks, buckets, starts, pieces)
    strict = key is None if strict is None else strict
    return merge_states(states, specs, limit, fan_in, strict)


def spec_of(row, grid_id: int = 0) -> Spec:
    """Spec of a stored state, enough to go on with it."""
    kind = "batch_fd" if row["kind"] == "dynamic_fd" else row["kind"]
    return Spec(kind, row["l"], b=row["b"], alpha=row["alpha"], grid_id=grid_id)


def update_sketch(states: DataFrame, matrix: DataFrame, spec: Spec, key: str | None = None, m=None) -> DataFrame:
    """Continue stored states (of one spec) with further rows."""
    return merge_pair(states, sketch(matrix, spec, key, m, strict=False), spec)


def merge_pair(left: DataFrame, right: DataFrame, spec: Spec) -> DataFrame:
    """Merge two sets of final states key by key: row-wise union, then one merge round."""
    both = left.select(*_ARROW.names).withColumn("part", F.lit(0)).unionByName(
        right.select(*_ARROW.names).withColumn("part", F.lit(1))
    )
    both = both.withColumn("phase", F.lit(2)).withColumn("grid_id", F.lit(spec.grid_id))
    return merge_states(both, [spec], 2)


def single(states: DataFrame) -> tuple[dict, np.ndarray]:
    """The only state of a table on the driver: its fields, and its data as an array."""
    table = states.toArrow()
    if table.num_rows != 1:
        raise ValueError(f"expected one state, found {table.num_rows}")
    data = table.column("data").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return table.drop_columns(["data"]).to_pylist()[0], data


def state_entries(states: DataFrame) -> DataFrame:
    """Sketch matrices in entry layout: key, grid_id, i, j, v."""
    cells = states.select("key", "grid_id", "m", F.posexplode("data").alias("at", "v"))
    return cells.select(
        "key",
        "grid_id",
        F.floor(F.col("at") / F.col("m")).cast("bigint").alias("i"),
        (F.col("at") % F.col("m")).cast("int").alias("j"),
        "v",
    )


def state_rows(states: DataFrame) -> DataFrame:
    """Sketch matrices in row layout: key, grid_id, row_id, vec."""
    starts = F.sequence(F.lit(0), F.col("filled") - 1)
    rows = states.filter("filled > 0").select("key", "grid_id", "m", "data", F.explode(starts).alias("r"))
    return rows.select(
        "key",
        "grid_id",
        F.col("r").cast("bigint").alias("row_id"),
        F.expr("slice(data, r * m + 1, m)").alias("vec"),
    )


def realised_size(states: DataFrame, l1: int, l2: int) -> DataFrame:
    """Effective size of a dynamic sketch: the mean of l1 and l2 weighted by the mass each phase
    subtracted; l2 when nothing was subtracted before the change."""
    d1 = F.col("delta_first")
    d2 = F.col("delta") - d1
    return states.withColumn(
        "l_hat", F.when(d1 == 0, F.lit(float(l2))).otherwise((l1 * d1 + l2 * d2) / (d1 + d2))
    )


__all__ = [
    "LINEAR",
    "STATE",
    "Spec",
    "merge_pair",
    "merge_states",
    "partial_states",
    "realised_size",
    "single",
    "sketch",
    "spec_of",
    "state_entries",
    "state_rows",
    "update_sketch",
]
