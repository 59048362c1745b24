"""Runs of equal keys in sorted partitions, handed to numpy one bounded run at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key as one table; the partition must be sorted by ``keys``."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cut = np.zeros(batch.num_rows, bool)
        for c in columns:
            cut[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        bounds = [0, *np.flatnonzero(cut).tolist(), batch.num_rows]
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(bounds[:-2], bounds[1:-1], strict=True):
            held.append(batch.slice(a, b - a))
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(bounds[-2], bounds[-1] - bounds[-2]))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)
