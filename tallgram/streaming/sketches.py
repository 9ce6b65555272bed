"""Streaming sketches.

The rows of a micro-batch are first condensed inside the tasks that read them (the same kernel as
in batch), so what is exchanged and what meets the stored state are sketch states, never rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.kernels import Spec, merger
from ..operators.linear import count_sketch
from ..operators.sketch import STATE, _labelled, merge_pair, partial_states, sketch
from ..session import delete_path

_VERSION = STATE + ", batch bigint"
#: Versions of a running sketch kept on disk, in a ring.
SLOTS = 8
_NAMES = [f.split()[0] for f in STATE.split(", ")]


def run_available(writer, checkpoint: str):
    """Process what the source holds now, then stop."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def _slot(path: str, batch_id: int) -> str:
    return f"{path}/slot={batch_id % SLOTS}"


def _read_version(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """State after ``batch_id``, or None when that batch never completed."""
    try:
        found = spark.read.schema(_VERSION).parquet(_slot(path, batch_id))
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    current = found.filter(F.col("batch") == batch_id).drop("batch")
    # A version without rows is that of a stream which has delivered nothing yet.
    return None if current.isEmpty() and not found.isEmpty() else current


def stream_sketch(stream: DataFrame, spec: Spec, path: str, schedule=None):
    """Running sketch: ``writeStream`` whose micro-batches update the state stored under ``path``.

    Version ``batch_id`` is version ``batch_id - 1`` merged with the batch. Versions go to a ring of
    ``SLOTS`` folders, each overwritten as a whole: a replayed batch recomputes its own version from
    the one before instead of counting its rows twice, and storage stays bounded.
    ``schedule(batch_id) -> l`` may raise the size while the stream runs; l never shrinks below what
    the state already holds, so no mass is dropped unshrunk, and ``delta_first`` keeps the mass
    subtracted before the last change.
    """

    def absorb(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        size = schedule(batch_id) if schedule else spec.l
        now = Spec(spec.kind, size, b=spec.b, alpha=spec.alpha, svd=spec.svd, seed=spec.seed)
        if batch_id == 0:  # a new stream: versions of an older one don't count; nothing else here is touched
            for slot in range(SLOTS):
                delete_path(spark, f"{path}/slot={slot}")
        fresh = sketch(batch, now, strict=False)
        before = _read_version(spark, path, batch_id - 1) if batch_id > 0 else None
        if batch_id > 0 and before is None:
            raise RuntimeError(f"state of batch {batch_id - 1} is missing under {path}")
        if before is not None:
            changed = F.when(F.col("l") != size, F.col("delta")).otherwise(F.col("delta_first"))
            before = before.withColumn("delta_first", changed)
            fresh = merge_pair(before, fresh, now)
        stamped = fresh.withColumn("batch", F.lit(batch_id).cast("bigint"))
        stamped.write.mode("overwrite").parquet(_slot(path, batch_id))

    return stream.writeStream.foreachBatch(absorb)


def current_state(spark: SparkSession, path: str) -> DataFrame:
    """Latest completed version of a running sketch."""
    versions = spark.read.schema(_VERSION).option("basePath", path).parquet(f"{path}/slot=*")
    last = versions.agg(F.max("batch")).scalar()
    return versions.filter(F.col("batch") == last).drop("batch", "slot")


_STATE_SCHEMA = (
    "m int, filled int, n_rows bigint, delta double, delta_first double, mass_lost double, "
    "data array<double>"
)


def _fold(acc, spec: Spec, frames):
    for frame in frames:
        for row in frame.to_dict("records"):
            if acc is None:
                acc = merger(spec, int(row["m"]))
                acc.mark = None
            acc.merge(row | {"data": np.asarray(row["data"])})
    return acc


def _saved(acc) -> tuple:
    s = acc.state()
    return (
        s["m"], s["filled"], s["n_rows"], s["delta"], s["delta_first"], s["mass_lost"],
        [float(x) for x in s["data"]],
    )


def _loaded(spec: Spec, saved: tuple):
    names = [f.split()[0] for f in _STATE_SCHEMA.split(", ")]
    row = dict(zip(names, saved))
    acc = merger(spec, int(row["m"]))
    acc.mark = None
    acc.merge(row | {"data": np.asarray(row["data"], dtype=np.float64)})
    return acc


def stream_sketch_keyed(stream: DataFrame, key: str, spec: Spec) -> DataFrame:
    """One resumable sketch per key; emits the key's current state after each micro-batch."""
    spec = spec.check()
    partial = partial_states(stream, [spec], key=key)

    def update(group, frames, state: GroupState):
        acc = _loaded(spec, state.get) if state.exists else None
        acc = _fold(acc, spec, frames)
        state.update(_saved(acc))
        yield pd.DataFrame([_labelled(acc, spec, group[0], 0, 0)])[_NAMES]

    return partial.groupBy("key").applyInPandasWithState(
        update, STATE, _STATE_SCHEMA, "update", GroupStateTimeout.NoTimeout
    )


def _millis(spark: SparkSession, interval: str) -> int:
    """Length of an interval such as '1 hour 30 minutes'."""
    return spark.sql(f"SELECT unix_millis(TIMESTAMP_MICROS(0) + INTERVAL {interval}) AS ms").first().ms


def stream_sketch_windowed(
    stream: DataFrame, ts: str, width: str, delay: str, spec: Spec, slide: str | None = None
) -> DataFrame:
    """One sketch per event-time window, emitted when the watermark passes its end; the window end is
    the group key, in milliseconds. ``slide`` makes the windows overlap: rows are condensed in panes that
    do not, and the states of the panes are copied to the windows they lie in.

    Lateness is judged by the window's end: the watermark lies ``delay`` and one ``width`` behind the
    latest window end seen, so no row of an open window is dropped however the rows of a micro-batch
    were condensed, and a window is emitted up to one width later than its last row would allow.
    Rows for windows that have been emitted are dropped.
    """
    spec = spec.check()
    long = _millis(stream.sparkSession, width)
    pane = math.gcd(long, _millis(stream.sparkSession, slide or width))
    timed = stream.withColumn("pane_end", F.unix_millis(F.window(ts, f"{pane} milliseconds").end))
    panes = partial_states(timed, [spec], key="pane_end")
    if slide:
        start = F.timestamp_millis(F.col("key").cast("bigint") - pane)
        panes = panes.withColumn("start", start).withColumn("w", F.window("start", width, slide))
        panes = panes.withColumn("key", F.unix_millis("w.end").cast("string")).drop("start", "w")
    partial = (
        panes.withColumn("closes", F.timestamp_millis(F.col("key").cast("bigint")))
        .withWatermark("closes", f"{_millis(stream.sparkSession, delay) + long} milliseconds")
    )

    def update(group, frames, state: GroupState):
        if state.hasTimedOut:
            acc = _loaded(spec, state.get)
            state.remove()
            yield pd.DataFrame([_labelled(acc, spec, group[0], 0, 0, True)])[_NAMES]
            return
        closes = int(group[0])
        if closes <= state.getCurrentWatermarkMs():
            return
        acc = _loaded(spec, state.get) if state.exists else None
        acc = _fold(acc, spec, frames)
        state.update(_saved(acc))
        state.setTimeoutTimestamp(closes)

    return partial.groupBy("key").applyInPandasWithState(
        update, STATE, _STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout
    )


def stream_count_sketch(stream: DataFrame, l: int) -> DataFrame:
    """CountSketch as a streaming aggregation (complete or update mode); no Python involved."""
    return count_sketch(stream, l)
