"""Sketches of unbounded row streams (Structured Streaming)."""

from .keyed import rocksdb_states, stream_sketches
from .sessions import stream_sketch_sessions
from .sketches import (
    current_state,
    run_available,
    stream_count_sketch,
    stream_sketch,
    stream_sketch_keyed,
    stream_sketch_windowed,
)

__all__ = [
    "current_state",
    "rocksdb_states",
    "run_available",
    "stream_count_sketch",
    "stream_sketch",
    "stream_sketch_keyed",
    "stream_sketch_sessions",
    "stream_sketch_windowed",
    "stream_sketches",
]
