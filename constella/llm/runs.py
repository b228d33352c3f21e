"""Sorted runs of rows inside a partition, handed to a kernel without a call per group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key in turn; the input holds the rows of a key side by side."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and (a > 0 or any(held[-1].column(k)[-1].as_py() != c[0] for k, c in zip(keys, columns, strict=True))):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def fixed(column: pa.ChunkedArray, dtype: type, width: int) -> np.ndarray:
    """A matrix from a binary column whose values all hold ``width`` items."""
    out = [np.frombuffer(c.buffers()[2], dtype=np.uint8)[np.frombuffer(c.buffers()[1], dtype=np.int32)[c.offset] : np.frombuffer(c.buffers()[1], dtype=np.int32)[c.offset + len(c)]] for c in column.chunks]
    return np.concatenate(out).view(dtype).reshape(-1, width)
