"""Helpers for functions over streams of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

PIECE = 8 << 20


def pieces(batches: Iterable[pa.RecordBatch], column: int, limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that a string column has about ``limit`` bytes in each (one row at least)."""
    for batch in batches:
        array = batch.column(column)
        if not batch.num_rows:
            continue
        kind = np.int64 if pa.types.is_large_string(array.type) else np.int32
        offsets = np.frombuffer(array.buffers()[1], dtype=kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
        at = 0
        while at < len(array):
            stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
            stop = min(stop, len(array))
            yield batch.slice(at, stop - at)
            at = stop


def int64(column: pa.Array) -> np.ndarray:
    """Values of an integer column; null reads as 0."""
    column = column.fill_null(0) if column.null_count else column
    return column.to_numpy(zero_copy_only=False)


def groups(batches: Iterable[pa.RecordBatch], keys: int, least: int = 1) -> Iterator[tuple[tuple[int, ...], pa.Table]]:
    """Runs of rows alike in the first ``keys`` columns (longs), of a stream sorted by them.

    Runs of fewer than ``least`` rows are passed over.
    """
    held: list[pa.RecordBatch] = []
    now: tuple[int, ...] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [int64(batch.column(k)) for k in range(keys)]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for lo, hi in zip(starts[:-1], starts[1:], strict=True):
            if hi - lo < least and 0 < lo and hi < batch.num_rows:
                continue
            key = tuple(int(c[lo]) for c in columns)
            if now is not None and key != now:
                if sum(b.num_rows for b in held) >= least:
                    yield now, pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(lo, hi - lo))
    if now is not None and sum(b.num_rows for b in held) >= least:
        yield now, pa.Table.from_batches(held)


def blobs(column: pa.ChunkedArray | pa.Array, dtype: type) -> np.ndarray:
    """All values packed into the cells of a binary column."""
    parts = [np.frombuffer(x.as_buffer(), dtype=dtype) for x in column if x.is_valid]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def split_by(part: np.ndarray, n: int, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Deals arrays out by part number, in 0..n-1."""
    order = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(n + 1))
    arrays = tuple(a[order] for a in arrays)
    for k in range(n):
        if ends[k + 1] > ends[k]:
            yield k, [a[ends[k] : ends[k + 1]] for a in arrays]
