"""Groups of rows that lie together in the batches of a sorted partition."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def runs(batches, width: int):
    """Tables of consecutive rows that are equal in their first ``width`` columns, all longs."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
        keys = [table.column(k).to_numpy() for k in range(width)]
        change = np.zeros(table.num_rows - 1, dtype=bool)
        for key in keys:
            change |= key[1:] != key[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist()]
        for low, high in zip(cuts, cuts[1:]):
            yield table.slice(low, high - low)
        held = table.slice(cuts[-1])
    if held is not None:
        yield held
