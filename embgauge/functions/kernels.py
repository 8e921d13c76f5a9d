"""Arrow list columns to numpy matrices and back, for use inside Spark tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# A d x d model is held by the driver and sent to every executor, so its width is bounded.
MAX_WIDTH = 8192
MAX_BROADCAST_BYTES = 1 << 30


def to_matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """List column to a float64 matrix; missing vectors, missing entries and ragged widths fail."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, width or 0))
    flat = column.flatten()
    if column.null_count or flat.null_count:
        raise ValueError("embedding column holds nulls")
    lengths = np.diff(np.asarray(column.offsets))
    expected = int(lengths[0]) if width is None else width
    if (lengths != expected).any():
        raise ValueError(f"embedding width differs from {expected}")
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return values.reshape(len(column), expected)


def to_lists(matrix: np.ndarray) -> pa.Array:
    rows, width = matrix.shape
    offsets = pa.array(np.arange(0, rows * width + 1, max(width, 1), dtype=np.int32)[: rows + 1])
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(matrix, dtype=np.float64).ravel()))


def share(spark, model, nbytes: int, what: str):
    """Send a model to the executors, if it is small enough for that."""
    if nbytes > MAX_BROADCAST_BYTES:
        raise ValueError(f"{what} of {nbytes} bytes are too large to send to every executor")
    return spark.sparkContext.broadcast(model)


def row_chunks(rows: int, width: int, target_bytes: int = 64 << 20):
    """Slices whose ``slice x width`` float64 matrix stays near ``target_bytes``."""
    step = max(1, target_bytes // (8 * max(width, 1)))
    for start in range(0, rows, step):
        yield slice(start, min(start + step, rows))
