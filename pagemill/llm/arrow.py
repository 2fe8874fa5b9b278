"""Helpers for Arrow batches in Python workers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters that one slice of a batch holds at most (one longer text makes a slice by itself).
SLICE_CHARS = 1_500_000


def slices(batches: Iterator[pa.RecordBatch], column: str, chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut batches into slices of a bounded amount of text, so that memory follows the slice and not the batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0), dtype=np.int64)
        group = np.cumsum(sizes) // chars
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(int(a), int(b - a))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts one after the other, and the offsets of the texts (one more than texts)."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return flat, np.concatenate([[0], np.cumsum(lengths)])


def batch_of(schema: pa.Schema, columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)
