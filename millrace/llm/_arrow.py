"""Small helpers for functions that Spark calls with Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 8 << 20


def pieces(
    batches: Iterator[pa.RecordBatch], column: str = "text", max_bytes: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """The batches again, cut between rows so that a piece holds about ``max_bytes`` of text.

    A row is never cut: one longer than that is a piece of its own. Empty batches
    are left out.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        before = np.cumsum(lengths.to_numpy(zero_copy_only=False)) - 1
        start = 0
        while start < batch.num_rows:
            base = before[start - 1] if start else -1
            stop = int(np.searchsorted(before, base + max_bytes, side="right"))
            stop = max(stop, start + 1)
            yield batch.slice(start, stop - start)
            start = stop


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and where each row starts and the last ends; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def binary_rows(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column over ``data`` (any dtype), with ``offsets`` in items of it."""
    raw = np.ascontiguousarray(data)
    at = (offsets * raw.itemsize).astype(np.int64)
    buffers = [None, pa.py_buffer(at), pa.py_buffer(raw.view(np.uint8))]
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, buffers).cast(pa.binary())


def appended(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """The batch with these columns behind its own."""
    return pa.RecordBatch.from_arrays(
        [*batch.columns, *columns.values()], [*batch.schema.names, *columns]
    )
