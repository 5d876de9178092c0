"""Arrow string and list columns as flat NumPy buffers with row offsets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 row offsets of a string or binary column; nulls count as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    if not len(column) or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8), o - o[0]


def flat_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and int64 row offsets of a list column without nulls inside; null lists count as empty."""
    values = np.asarray(column.flatten())
    sizes = np.asarray(column.value_lengths().fill_null(0), np.int64)
    return values, np.concatenate([[0], np.cumsum(sizes)])


def lists_of(values: np.ndarray, offs: np.ndarray, kind: pa.DataType, like: pa.Array | None = None) -> pa.Array:
    """A list column from flat values and offsets, null where ``like`` is."""
    mask = like.is_null() if like is not None and like.null_count else None
    return pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(values, kind), mask=mask)


def gathered(at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places at, at + 1, ... at + size - 1 of each entry, one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(at - before, sizes) + np.arange(int(sizes.sum()))


def by_bytes(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of rows of about ``most`` bytes; a larger row stands alone."""
    total = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = int(total[at - 1]) if at else 0
        stop = max(int(np.searchsorted(total, base + most, "right")), at + 1)
        yield slice(at, stop)
        at = stop
