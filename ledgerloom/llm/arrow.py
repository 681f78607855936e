"""Moving columns between Arrow batches and numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null gives b""."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    return [x if x is not None else b"" for x in column.to_pylist()]


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, type=kind))


def rows_of(column: pa.Array, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column without null rows."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return values, np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
