"""One sketch per key and session of an event-time stream."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..layouts import dense_block
from ..operators.kernels import SHRINKING, Spec
from ..operators.many import Pool, States, coded, merged, run_heads, together
from ..operators.sketch import LIVE_BYTES, STATE, _absorb, labelled_batch
from ..session import check_bytes, map_arrow, matrix_budget

_CLOSED = STATE + ", first_us bigint, last_us bigint"
#: Condensed panes of a group of keys: a row of a pane, with a list of each column of its keys' states.
_CONDENSED = (
    "grp int, pane bigint, keys array<string>, first_us array<bigint>, last_us array<bigint>, m array<int>, "
    "n_rows array<bigint>, delta array<double>, mass_lost array<double>, cells array<int>, data array<double>"
)
_KEPT = "sessions binary, timer bigint"
#: Groups that keys are dealt to.
GROUPS = 512
#: States, and numbers of them, in one row of a pane; sessions that are emitted in one batch of rows.
PACKED, PACKED_NUMBERS, TOGETHER = 1 << 12, 1 << 17, 1 << 12
_NAMES = [f.split()[0] for f in _CLOSED.split(", ")]


def condense_panes(batches, spec: Spec, width: int, budget: int):
    """States of the rows of one task by key and pane, each with the first and last time of its rows, packed by
    group and pane. Rows have their group, ``grp``, which follows from the key."""
    found = _together(batches, spec, width, budget) if spec.kind in SHRINKING and together(spec) else _one_by_one(batches, spec, width, budget)
    for keys, pane, lows, highs, states in found:
        yield from _packed(keys, pane, lows[1], lows[0], highs[0], states)


def _together(batches, spec: Spec, width: int, budget: int):
    pool = Pool(spec)
    for batch in batches:
        if not batch.num_rows:
            continue
        block = dense_block(batch.column("vec"))
        check_bytes(spec.state_bytes(block.shape[1]), f"a {spec.kind} state", budget)
        us, group = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("us", "grp"))
        yield from pool.add(batch.column("key"), us - us % width, [us, group], [us], States.of_rows(block))
    yield from pool.rest()


def _one_by_one(batches, spec: Spec, width: int, budget: int):
    """The same for kinds that need an accumulator for each pane."""
    spans: dict[str, tuple[int, int, int]] = {}

    def named():
        for batch in batches:
            if not batch.num_rows:
                continue
            names = []
            for key, us, group in zip(*(batch.column(c).to_pylist() for c in ("key", "us", "grp"))):
                name = f"{us - us % width}:" + ("" if key is None else "=" + key)
                old = spans.get(name, (us, us, group))
                spans[name] = min(old[0], us), max(old[1], us), group
                names.append(name)
            columns = [batch.column(c) for c in batch.schema.names if c not in ("us", "grp", "key")]
            kept = [c for c in batch.schema.names if c not in ("us", "grp", "key")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string())], [*kept, "key"])

    for found in _absorb(named(), (spec,), {}, None, LIVE_BYTES, budget):
        names = found.column("key").to_pylist()
        first, last, group = (np.array(c, dtype=np.int64) for c in zip(*(spans[name] for name in names)))
        panes, _, own = zip(*(name.partition(":") for name in names))
        keys = pa.array([x[1:] if x else None for x in own], pa.string())
        yield keys, np.array(panes, dtype=np.int64), [first, group], [last], States.of_batch(found)


def _packed(keys, pane, group, first, last, states: States):
    order = np.lexsort((pane, group))
    keys, pane, group, first, last = keys.take(pa.array(order)), pane[order], group[order], first[order], last[order]
    states = states.take(order)
    ends = np.cumsum(states.cells)
    heads = run_heads(group, pane, np.arange(len(order)) // PACKED, ends // PACKED_NUMBERS)
    for at in range(0, len(heads), 4096):
        low = heads[at]
        edges = np.append(heads[at : at + 4097], len(order))[: min(4096, len(heads) - at) + 1]
        some = slice(low, edges[-1])

        def lists(x, kind, cuts=edges - low):
            return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), x if isinstance(x, pa.Array) else pa.array(x, kind))

        numbers = np.append(0, ends)[edges]
        whole = [pa.array(group[edges[:-1]], pa.int32()), pa.array(pane[edges[:-1]], pa.int64()), lists(keys.slice(low, edges[-1] - low), None)]
        parts = [(first, pa.int64()), (last, pa.int64()), (states.m, pa.int32()), (states.n_rows, pa.int64()), (states.delta, pa.float64()), (states.mass_lost, pa.float64()), (states.cells, pa.int32())]
        data = lists(states.data[numbers[0] : numbers[-1]], pa.float64(), numbers - numbers[0])
        yield pa.RecordBatch.from_arrays([*whole, *(lists(x[some], kind) for x, kind in parts), data], [f.split()[0] for f in _CONDENSED.split(", ")])


_STORED = ["key", "first", "last", "m", "n_rows", "delta", "mass_lost", "data"]


def _dumped(keys, first, last, states: States) -> bytes:
    columns = [keys, *map(pa.array, (first, last, states.m, states.n_rows, states.delta, states.mass_lost)), states.lists()]
    batch = pa.RecordBatch.from_arrays(columns, _STORED)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _loaded(held: bytes) -> tuple:
    batch = pa.ipc.open_stream(held).read_next_batch()
    first, last, m, n_rows, delta, lost = (batch.column(c).to_numpy(zero_copy_only=False).copy() for c in _STORED[1:-1])
    data = batch.column("data")
    cells = np.diff(data.offsets.to_numpy()).astype(np.int64)
    return batch.column("key"), first, last, States(m, n_rows, delta, np.zeros(len(m)), lost, cells, data.flatten().to_numpy())


def _read(frame: pd.DataFrame, group: tuple) -> tuple:
    """Keys, first and last times and states of packed panes, or of single states of the group's own key."""
    if "keys" not in frame:
        data = [np.asarray(x, dtype=np.float64).ravel() for x in frame["data"]]
        keys = pa.array([group[0]] * len(frame), pa.string())
        numbers = {c: frame[c].to_numpy() for c in ("first_us", "last_us", "m", "n_rows", "delta", "mass_lost")} | {"cells": np.array([len(x) for x in data])}
    else:
        data = list(frame["data"])
        keys = pa.array([key for row in frame["keys"] for key in row], pa.string())
        numbers = {c: np.concatenate(list(frame[c])) for c in ("first_us", "last_us", "m", "n_rows", "delta", "mass_lost", "cells")}
    first, last, m, n_rows, cells = (numbers[c].astype(np.int64) for c in ("first_us", "last_us", "m", "n_rows", "cells"))
    delta, lost = (numbers[c].astype(np.float64) for c in ("delta", "mass_lost"))
    return keys, first, last, States(m, n_rows, delta, np.zeros(len(m)), lost, cells, np.concatenate(data).astype(np.float64))


class SessionSketch(StatefulProcessor):
    """The open sessions of a group of keys, spans and sketches, in one value that is read and written as a whole:
    each call to the state store costs more than many sessions' numbers. A group has one timer, for its next
    session to close."""

    def __init__(self, spec: Spec, gap: int):
        self.spec, self.gap = spec, gap

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("sessions", _KEPT)

    def _open(self) -> tuple[tuple | None, int | None]:
        """Keys, first and last times and sketches of the open sessions, and the timer."""
        if not self.kept.exists():
            return None, None
        held, timer = self.kept.get()
        return _loaded(bytes(held)), timer

    def _save(self, sessions: tuple, timer: int | None) -> None:
        """``timer`` is the one that is still to fire; it is replaced where a session closes before it."""
        if not len(sessions[0]):
            self.kept.clear()
            return
        due = int(self.closes(sessions[2]).min())
        if timer is None or due < timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
            timer = due
        self.kept.update((_dumped(*sessions), timer))

    def closes(self, last):
        """Millisecond the watermark must reach: rows that still may come then are ``gap`` later at least."""
        return -(-(last + 2 * self.gap) // 1000)

    def _joined(self, parts: list[tuple]) -> tuple:
        """Sessions of all parts, as one where less than the gap lies between them."""
        keys = pa.concat_arrays([x[0] for x in parts])
        first, last = (np.concatenate([x[n] for x in parts]) for n in (1, 2))
        codes = coded(keys)
        order = np.lexsort((last, first, codes))
        codes, first, last = codes[order], first[order], last[order]
        latest, rank = np.unique(last, return_inverse=True)
        own = np.cumsum(np.append(0, codes[1:] != codes[:-1]))
        reached = latest[np.maximum.accumulate(rank + own * len(latest)) - own * len(latest)]
        apart = np.append(True, (codes[1:] != codes[:-1]) | (first[1:] - reached[:-1] >= self.gap))
        heads = np.flatnonzero(apart)
        states = merged(States.joined([x[3] for x in parts]).take(order), heads, self.spec)
        return keys.take(pa.array(order[heads])), first[heads], np.maximum.reduceat(last, heads), states

    def handleInputRows(self, key, rows, timerValues):
        sessions, timer = self._open()
        for frame in rows:
            met = _read(frame, key)
            sessions = self._joined([met] if sessions is None else [sessions, met])
        if sessions is not None:
            self._save(sessions, timer)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        sessions, _ = self._open()
        if sessions is None:
            return
        keys, first, last, states = sessions
        closed = self.closes(last) <= now
        done, stay = np.flatnonzero(closed), np.flatnonzero(~closed)
        for at in range(0, len(done), TOGETHER):
            some = done[at : at + TOGETHER]
            yield self._closed(keys.take(pa.array(some)), first[some], last[some], states.take(some))
        self._save((keys.take(pa.array(stay)), first[stay], last[stay], states.take(stay)), None)

    def _closed(self, keys, first, last, states: States) -> pd.DataFrame:
        rows = labelled_batch(keys, self.spec, 0, 0, merged(states, np.arange(len(states)), self.spec, True))
        return rows.to_pandas().assign(mark=None, first_us=first, last_us=last)[_NAMES]

    def close(self) -> None:
        pass


def stream_sketch_sessions(
    stream: DataFrame, key: str, ts: str, gap: str, delay: str, spec: Spec, groups: int = GROUPS
) -> DataFrame:
    """One sketch per key and session, with its ``session_start`` and ``session_end`` (the times of its
    first and last row), emitted once no row can join it (append mode; start the query inside
    ``rocksdb_states``). A ``gap`` without rows of the key, or a longer one, ends a session; a late row
    that bridges two open sessions makes them one.

    Rows are condensed where they are read: rows of a key in one pane of ``gap`` (of time since 1970)
    belong to one session, so what is exchanged are states of panes, with the first and last time in them.
    Lateness is judged by the pane, for all of its rows alike: the watermark lies ``delay`` and one
    ``gap`` behind the latest pane's end, no row that is late by ``delay`` at most is dropped, and what
    is emitted equals a batch over the rows that were not. A session is emitted when the watermark is two
    gaps past its last row. A key has at most ``delay / gap + 4`` open sessions.

    Keys are dealt to ``groups`` by their hash; a group's open sessions are one state value, merged and
    closed by steps over arrays. A micro-batch rewrites the values of the groups it has rows of, so more
    groups suit more keys and smaller batches; their number must stay as it is when a query is restarted.

    Rows without a time belong to no session and are left out; a NULL key is a key of its own.
    """
    spec = spec.check()
    width, late = (_micros(stream.sparkSession, x) for x in (gap, delay))
    if width <= 0 or width % 1000 or late < 0:
        raise ValueError("a gap is a positive number of milliseconds, a delay not negative")
    if groups < 1:
        raise ValueError("sessions need a group of keys")
    timed = stream.filter(F.col(ts).isNotNull()).withColumn("us", F.unix_micros(F.col(ts).cast("timestamp")))
    rows = timed.select("row_id", "vec", F.col(key).cast("string").alias("key"), "us")
    rows = rows.withColumn("grp", F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int"))
    budget = matrix_budget()
    condensed = map_arrow(rows, lambda batches: condense_panes(batches, spec, width, budget), _CONDENSED)
    settles = F.timestamp_micros(F.col("pane") + width)
    partial = condensed.withColumn("settles", settles).withWatermark("settles", f"{(late + width) // 1000} milliseconds")
    closed = partial.groupBy("grp").transformWithStateInPandas(
        statefulProcessor=SessionSketch(spec, width), outputStructType=_CLOSED, outputMode="Append", timeMode="EventTime"
    )
    times = [F.timestamp_micros(c).alias(name) for c, name in (("first_us", "session_start"), ("last_us", "session_end"))]
    return closed.select(*[f.split()[0] for f in STATE.split(", ")], *times)


def _micros(spark, interval: str) -> int:
    return spark.sql(f"SELECT unix_micros(TIMESTAMP_MICROS(0) + INTERVAL {interval}) AS us").first().us
