"""Runs of equal keys in Arrow batches that arrive sorted by them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """One table per run. Keys are integers that are never null. Only the run at hand is held."""
    held: list[pa.RecordBatch] = []
    last: tuple[int, ...] | None = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(n, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        change[0] = last is not None and tuple(int(c[0]) for c in columns) != last
        cuts = np.flatnonzero(change).tolist()
        low = 0
        for cut in cuts:
            if cut > low:
                held.append(batch.slice(low, cut - low))
            if held:
                yield pa.Table.from_batches(held)
            held, low = [], cut
        held.append(batch.slice(low))
        last = tuple(int(c[-1]) for c in columns)
    if held:
        yield pa.Table.from_batches(held)
