"""Arrow batches in Python workers: slices of bounded size, lists of lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one slice of a batch holds at most (one longer text makes a slice by itself).
SLICE = 4_000_000


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Cut batches into slices of a bounded amount of text, so that memory follows the slice and not the batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0), dtype=np.int64)
        group = np.cumsum(sizes) // size
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(int(a), int(b - a))


def split_lines(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(row of each line, lines, number of the line in its text) of all texts; null has none."""
    lists = pc.split_pattern(texts.cast(pa.large_string()), "\n")
    row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    lines = pc.list_flatten(lists)
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if row.size else np.zeros(0, np.int64)
    order = np.arange(row.size) - np.repeat(first, np.diff(np.r_[first, row.size]))
    return row, lines.cast(pa.string()), order


def running(values: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Sums of ``values`` up to and with each line, beginning anew where ``order`` is 0."""
    total = np.cumsum(values)
    first = np.flatnonzero(order == 0)
    before = np.r_[0, total][first] if first.size else np.zeros(0, np.int64)
    return total - np.repeat(before, np.diff(np.r_[first, values.size]))
