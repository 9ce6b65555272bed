"""One resumable sketch per key on arbitrary state: started from stored sketches, resized while running."""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.kernels import Spec, merger
from ..operators.sketch import STATE, partial_states

SIZED = STATE + ", l_hat double"
_KEPT = "l int, m int, n_rows bigint, delta double, weighted double, mass_lost double, data binary"
_NAMES = [f.split()[0] for f in SIZED.split(", ")]
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_states(spark: SparkSession):
    """The state store that the queries started inside need."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


class KeyedSketch(StatefulProcessor):
    """Folds condensed states, and control rows that raise the size, into one sketch a key.

    ``weighted`` is the subtracted mass times the size at which it was subtracted, so the realised size
    is its share of ``delta`` however often the size has grown.
    """

    def __init__(self, spec: Spec):
        self.spec = spec

    def init(self, handle) -> None:
        self.kept = handle.getValueState("sketch", _KEPT)

    def _read(self) -> dict:
        if not self.kept.exists():
            return dict(l=self.spec.l, m=0, n_rows=0, delta=0.0, weighted=0.0, mass_lost=0.0, data=b"")
        return dict(zip((f.split()[0] for f in _KEPT.split(", ")), self.kept.get()))

    def _absorb(self, kept: dict, rows: list[dict], l: int) -> dict:
        """The kept state after further states, at size ``l``."""
        m = kept["m"] or max((int(r["m"]) for r in rows), default=0)
        kept = kept | dict(l=l, m=m)
        if not m:
            return kept
        acc = merger(replace(self.spec, l=l), m)
        acc.merge(dict(n_rows=kept["n_rows"], delta=kept["delta"], delta_first=0.0, mass_lost=kept["mass_lost"], data=np.frombuffer(kept["data"])))
        for row in rows:
            acc.merge(dict(n_rows=int(row["n_rows"]), delta=row["delta"], delta_first=0.0, mass_lost=row["mass_lost"], data=np.asarray(row["data"], dtype=np.float64)))
        state = acc.state()
        weighted = kept["weighted"] + l * (state["delta"] - kept["delta"])
        return dict(l=l, m=m, n_rows=state["n_rows"], delta=state["delta"], weighted=weighted, mass_lost=state["mass_lost"], data=state["data"].tobytes())

    def _write(self, kept: dict) -> None:
        self.kept.update(tuple(kept[f.split()[0]] for f in _KEPT.split(", ")))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        rows = initialState.to_dict("records")
        self._write(self._absorb(self._read(), rows, max(self.spec.l, *(int(r["l"]) for r in rows))))

    def handleInputRows(self, key, rows, timerValues):
        found = [r for frame in rows for r in frame.to_dict("records")]
        sizes = [int(r["l"]) for r in found if r["kind"] == "control"]
        kept = self._read()
        # control rows of a micro-batch count before its data; a size never shrinks
        kept = self._absorb(kept, [r for r in found if r["kind"] != "control"], max([kept["l"], *sizes]))
        self._write(kept)
        if not kept["n_rows"]:
            return
        data = np.frombuffer(kept["data"])
        l_hat = kept["weighted"] / kept["delta"] if kept["delta"] > 0 else float(kept["l"])
        row = dict(
            key=key[0], grid_id=self.spec.grid_id, phase=0, part=0, kind="dynamic_fd" if l_hat < kept["l"] else self.spec.kind,
            l=kept["l"], b=self.spec.extra, alpha=self.spec.alpha, m=kept["m"], filled=len(data) // kept["m"], n_rows=kept["n_rows"],
            delta=kept["delta"], delta_first=0.0, mass_lost=kept["mass_lost"], mark=None, data=data, l_hat=l_hat,
        )
        yield pd.DataFrame([row])[_NAMES]

    def close(self) -> None:
        pass


def stream_sketches(
    stream: DataFrame, key: str, spec: Spec, control: DataFrame | None = None, initial: DataFrame | None = None, largest: int | None = None
) -> DataFrame:
    """One sketch per key, emitted with its realised size ``l_hat`` after each micro-batch that has rows
    or control rows for it (update mode; start the query inside ``rocksdb_states``).

    ``control`` is a stream (key, l): its rows raise the size of a key's sketch to l, before the data
    of the same micro-batch is absorbed. Rows are condensed where they are read to ``largest`` rows (the
    largest size that control rows may ask for), as tasks don't know the sizes. ``initial`` holds final
    sketch states (with ``key``) of earlier rows, as ``sketch`` gives them; a key goes on from its own.
    """
    spec = spec.check()
    wide = replace(spec, l=max(spec.l, largest or 0))
    both = partial_states(stream, [wide], key=key)
    if control is not None:
        given = dict(key=F.col("key").cast("string"), kind=F.lit("control"), l=F.col("l").cast("int"))
        fields = [(f.split()[0], f.split()[1]) for f in STATE.split(", ")]
        both = both.unionByName(control.select(*[given.get(n, F.lit(None).cast(t)).alias(n) for n, t in fields]))
    start = None if initial is None else initial.select(*[f.split()[0] for f in STATE.split(", ")]).groupBy("key")
    return both.groupBy("key").transformWithStateInPandas(
        statefulProcessor=KeyedSketch(spec), outputStructType=SIZED, outputMode="Update", timeMode="None", initialState=start
    )
