"""Arrow batches in slices: what a task holds depends on the tokens in a slice, not on the rows of a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_TOKENS = 1 << 20


def token_slices(batch: pa.RecordBatch, columns: list[int], limit: int = SLICE_TOKENS) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose lists in ``columns`` hold about ``limit`` values together (one row at least)."""
    if not batch.num_rows:
        return
    size = sum(batch.column(i).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for i in columns)
    part = np.cumsum(size) // limit
    cuts = np.flatnonzero(part[1:] != part[:-1]) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        yield batch.slice(a, b - a)


def flat_list(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A list column's values and the row of each; null lists are empty."""
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), size)
