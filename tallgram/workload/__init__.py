"""Registered queries: every operator applied to the shared test tables, with an SQL counterpart."""

from . import aggregates, algebra, clustering, scalar, sketches, sources, streams, sweeps  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
