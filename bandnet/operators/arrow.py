"""Helpers between Arrow columns and numpy arrays, and the size of Arrow batches."""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession


def matrix_from_lists(column: pa.Array, width: int, keep_floats: bool = False) -> np.ndarray:
    """A list column of equal-length rows as an (n, width) float64 matrix.

    With ``keep_floats`` a column of 32-bit floats stays one.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        raise ValueError("features must not be null")
    offsets = np.asarray(column.offsets)
    if len(column) and not np.all(np.diff(offsets) == width):
        raise ValueError(f"every feature vector must have {width} values")
    values = column.flatten()
    if values.null_count:
        raise ValueError("feature values must not be null")
    flat = values.to_numpy(zero_copy_only=False)
    if not (keep_floats and flat.dtype == np.float32):
        flat = np.asarray(flat, dtype=np.float64)
    return flat.reshape(len(column), width)


def lists_from_matrix(matrix: np.ndarray) -> pa.ListArray:
    """An (n, width) matrix as a list column."""
    rows, width = matrix.shape
    if rows * width > np.iinfo(np.int32).max:
        raise ValueError("an Arrow batch holds too many values; lower arrow.maxRecordsPerBatch")
    offsets = np.arange(rows + 1, dtype=np.int32) * np.int32(width)
    flat = np.ascontiguousarray(matrix, dtype=np.float64).reshape(-1)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def packed_binary(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Floats or doubles as a binary column, one item for every stretch between two cuts; not a copy."""
    flat = np.ascontiguousarray(values).reshape(-1)
    if flat.nbytes > np.iinfo(np.int32).max:
        raise ValueError("an Arrow batch holds too many values; lower arrow.maxRecordsPerBatch")
    offsets = (np.asarray(cuts, dtype=np.int64) * flat.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(flat)])


def numbers_from_binary(column: pa.Array, count: int) -> np.ndarray:
    """The ``count`` numbers of a packed binary column, end to end; not a copy.

    Their size follows from the count: four bytes are floats, eight are doubles.
    """
    if count == 0:
        return np.empty(0)
    _, offset_buffer, data = column.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    start, size = int(offsets[0]), int(offsets[-1] - offsets[0])
    kind = {4: "<f4", 8: "<f8"}[size // count]  # integers are told apart by who reads them
    return np.frombuffer(data, dtype=kind, offset=start, count=count)


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_cap_lock = threading.Lock()
#: Users and own value of every session that has a cap now
_cap_state: dict[str, list] = {}


@contextmanager
def small_batches(spark: SparkSession, size: str = "4m") -> Iterator[None]:
    """Cap the size of Arrow batches while a job is planned and run.

    Batches that fit in a core's cache make a pass over blocks about a third faster than the
    default of 64 MB. A session's own value comes back when the last of its users is done; other
    sessions of the process are left alone.
    """
    session = spark._jsparkSession.sessionUUID()
    with _cap_lock:
        if session not in _cap_state:
            _cap_state[session] = [0, spark.conf.get(_BATCH_BYTES)]
            spark.conf.set(_BATCH_BYTES, size)
        _cap_state[session][0] += 1
    try:
        yield
    finally:
        with _cap_lock:
            _cap_state[session][0] -= 1
            if _cap_state[session][0] == 0:
                spark.conf.set(_BATCH_BYTES, _cap_state.pop(session)[1])
