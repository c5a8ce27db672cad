"""Training blocks: rows packed into dense matrices so that executors can use matrix products.

A block is one row ``(n, x, y)``: the row count, ``n * width`` feature values row by row, and
``n`` labels or target vectors (empty when the network's target is its own input, so nothing is stored twice).
The values are packed as little-endian numbers in binary columns, which cross to Python about
twice as fast as arrays; features that come as 32-bit floats stay so and are widened only for
the arithmetic. Rows are packed within their partition, without a shuffle. Blocks packed with a key have a last column
``counters``, a number for each row from its key's hash, by which minibatches are drawn.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandnet.functions import feature_array, row_counter
from bandnet.operators.arrow import lists_from_matrix, matrix_from_lists, numbers_from_binary, packed_binary
from bandnet.sources.scratch import delete_path, scratch_path
from bandnet.operators.sparse import SPARSE_BLOCK_SCHEMA, SparseRows, pack_sparse, sparse_block_arrays, sparse_entries

BLOCK_SCHEMA = "n int, x binary, y binary"


def labeled_rows(
    df: DataFrame,
    features: str | None = "features",
    label: str | None = "label",
    width: int | None = None,
    target: str | None = None,
    target_width: int | None = None,
    values: Column | None = None,
    key: str | None = None,
) -> DataFrame:
    """Only what training needs: the features and, if there is one, the label as a double or the target vector.

    ``values`` is an expression for the features in place of a column. With ``key`` a column ``counter`` follows.
    """
    return df.select(*_labeled_columns(df, features, label, width, target, target_width, values, key))


def _labeled_columns(df, features, label, width=None, target=None, target_width=None, values=None, key=None) -> list[Column]:
    """The columns of ``labeled_rows``."""
    cols = [(feature_array(df, features, width) if values is None else values).alias("features")]
    if target is not None:
        cols.append(feature_array(df, target, target_width).alias("target"))
    elif label is not None:
        cols.append(F.col(label).cast("double").alias("label"))
    if key is not None:
        cols.append(row_counter(key).alias("counter"))
    return cols


def check_labels(df: DataFrame, label: str, classes: int) -> None:
    """Reject labels that are null or not one of 0..classes-1, reading the label column alone."""
    value = F.col(label).cast("double")
    bad = value.isNull() | (value < 0) | (value >= classes) | (value != F.floor(value)) | F.isnan(value)
    found = df.agg(
        F.sum(F.when(bad, 1).otherwise(0)).alias("bad"),
        F.min(F.when(bad, F.coalesce(value.cast("string"), F.lit("null")))).alias("example"),
    ).first()
    if found["bad"]:
        raise ValueError(
            f"{found['bad']} rows have a label outside 0..{classes - 1}, for example {found['example']}"
        )


def pack_rows(width: int, block_size: int, with_label: bool, target_width: int = 0, counted: bool = False):
    """Batches of ``(features, label)`` or ``(features, target)`` rows to batches of blocks, for one partition.

    With ``counted`` the last column of the rows is their counter.
    """
    each = target_width or int(with_label)

    def emit(x: np.ndarray, y: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        cuts = np.append(np.arange(0, len(x), block_size), len(x))
        columns = {
            "n": pa.array(np.diff(cuts).astype(np.int32)),
            "x": packed_binary(x, cuts * width),
            "y": packed_binary(y, cuts * each),
        }
        if counted:
            columns["counters"] = packed_binary(c, cuts)
        return pa.RecordBatch.from_pydict(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_x, held_y = np.empty((0, width), dtype=np.float32), np.empty((0, target_width) if target_width else 0)
        held_c = np.empty(0, np.int64)
        for batch in batches:
            x = matrix_from_lists(batch.column(0), width, keep_floats=True)
            if target_width:
                y = matrix_from_lists(batch.column(1), target_width)
            else:
                y = batch.column(1).to_numpy(zero_copy_only=False) if with_label else np.empty(0)
            c = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False) if counted else held_c
            if len(held_x):
                x, y, c = np.concatenate([held_x, x]), np.concatenate([held_y, y]), np.concatenate([held_c, c]) if counted else c
            whole = len(x) - len(x) % block_size
            if whole:
                yield emit(x[:whole], y[:whole], c[:whole])
            held_x, held_y, held_c = x[whole:].copy(), y[whole:].copy(), c[whole:].copy()
        if len(held_x):
            yield emit(held_x, held_y, held_c)

    return run


def stack_blocks(
    df: DataFrame,
    width: int,
    block_size: int = 128,
    features: str = "features",
    label: str | None = "label",
    target: str | None = None,
    target_width: int = 0,
    sparse: bool = False,
    key: str | None = None,
) -> DataFrame:
    """Pack rows into blocks of at most ``block_size``; the last block of a partition may be short.

    With ``target``, an array column of ``target_width`` values, blocks hold these vectors in place of labels. With
    ``sparse`` blocks hold only the entries of the features, which may be ML vectors or structs ``(indices, values)``.
    With ``key`` minibatches are drawn by row, alike on every layout of the table; a null key is an error.
    """
    if block_size <= 0:
        raise ValueError("block_size must be positive")
    if target is not None and target_width <= 0:
        raise ValueError("a target column needs target_width")
    each, with_label = (target_width, False) if target is not None else (0, label is not None)
    more = ", counters binary" if key is not None else ""
    if sparse:
        rows = labeled_rows(df, None, label, None, target, target_width, sparse_entries(df, features), key)
        return rows.mapInArrow(pack_sparse(width, block_size, with_label, each, key is not None), SPARSE_BLOCK_SCHEMA + more)
    rows = labeled_rows(df, features, label, width, target, target_width, key=key)
    return rows.mapInArrow(pack_rows(width, block_size, with_label, each, key is not None), BLOCK_SCHEMA + more)


def block_arrays(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray | SparseRows, np.ndarray, np.ndarray]:
    """A batch of blocks as one matrix of rows, their labels or target vectors, and the rows per block."""
    if "positions" in batch.schema.names:
        return sparse_block_arrays(batch, width)
    counts = np.asarray(batch.column(0))
    rows = int(counts.sum())
    x = numbers_from_binary(batch.column(1), rows * width).reshape(-1, width)
    labels = batch.column(2)
    each = len(labels[0].as_buffer() or b"") // (8 * int(counts[0])) if rows else 0
    y = numbers_from_binary(labels, rows * each)
    return x, y.reshape(rows, each) if each > 1 else y, counts


def block_counters(batch: pa.RecordBatch) -> np.ndarray:
    """The counters of a batch of blocks packed with a key."""
    rows = int(np.asarray(batch.column(0)).sum())
    return numbers_from_binary(batch.column("counters"), rows).view(np.int64) if rows else np.empty(0, np.int64)


def unstack_blocks(blocks: DataFrame, width: int, target_width: int = 0) -> DataFrame:
    """Blocks back to rows ``(features, label)``; the label is null where blocks hold none.

    Blocks of target vectors, told by ``target_width``, give ``(features, target)``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, _ = block_arrays(batch, width)
            x = x.toarray() if isinstance(x, SparseRows) else x
            if target_width:
                held, name = lists_from_matrix(y.reshape(len(x), target_width)), "target"
            else:
                held, name = pa.array(y) if len(y) else pa.nulls(len(x), pa.float64()), "label"
            yield pa.RecordBatch.from_arrays([lists_from_matrix(x), held], names=["features", name])

    return blocks.mapInArrow(run, "features array<double>, " + ("target array<double>" if target_width else "label double"))


MEASURES = "low array<double>, high array<double>, bad long, example string"


def measured_blocks(
    df: DataFrame,
    width: int,
    block_size: int = 128,
    features: str = "features",
    label: str | None = "label",
    classes: int | None = None,
    part: str | None = None,
    bounds_of: str | None = None,
    target: str | None = None,
    target_width: int = 0,
    key: str | None = None,
) -> DataFrame:
    """Blocks as ``stack_blocks`` makes them and, with the same pass over the rows, what has to be known of them.

    Every partition ends with a row of ``n = 0`` that has the smallest and largest value of each feature (of all rows or
    only the packed ones, ``bounds_of`` "all" or "train"; empty without), how many packed rows have a label outside
    ``0..classes - 1``, and one such label. With ``part``, a boolean column, only rows for which it is true are packed.
    """
    if bounds_of not in (None, "all", "train"):
        raise ValueError("bounds come from 'all' or 'train' rows")
    if block_size <= 0:
        raise ValueError("block_size must be positive")
    if target is not None and target_width <= 0:
        raise ValueError("a target column needs target_width")
    columns = _labeled_columns(df, features, label, width, target, target_width, key=key)
    names = df.select(*columns).columns
    packed = F.coalesce(F.col(part), F.lit(False)) if part is not None else F.lit(True)
    rows = df.select(packed.alias("packed"), *columns)
    with_label = target is None and label is not None
    pack = pack_rows(width, block_size, with_label, target_width if target is not None else 0, key is not None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full(width, np.inf), np.full(width, -np.inf)
        bad, example = 0, None

        def chosen() -> Iterator[pa.RecordBatch]:
            nonlocal bad, example
            for batch in batches:
                flags = batch.column(0)
                kept = pa.RecordBatch.from_arrays(batch.columns[1:], names=names).filter(flags)
                seen = batch.column(1) if bounds_of == "all" else kept.column(0)
                if bounds_of is not None and len(seen):
                    x = matrix_from_lists(seen, width, keep_floats=True)
                    np.fmin(low, x.min(axis=0) if not np.isnan(x).any() else np.fmin.reduce(x, axis=0), out=low)
                    np.maximum(high, x.max(axis=0), out=high)
                if classes is not None and len(kept):
                    y = kept.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
                    wrong = ~((y >= 0) & (y < classes) & (y == np.floor(y)))
                    if wrong.any():
                        bad += int(wrong.sum())
                        first = kept.column(1)[int(np.flatnonzero(wrong)[0])].as_py()
                        example = "null" if first is None else str(first)
                        kept = kept.filter(pa.array(~wrong))
                yield kept

        blocks = 0
        for block in pack(chosen()):
            blocks += block.num_rows
            nothing = [pa.nulls(block.num_rows, f.type) for f in measures]
            yield pa.RecordBatch.from_arrays([*block.columns, *nothing], names=[*block.schema.names, *measures.names])
        ends = [pa.array([v.tolist() if bounds_of is not None else []], pa.list_(pa.float64())) for v in (low, high)]
        empty = [pa.array([b""], pa.binary())] * (3 if key is not None else 2)
        names_out = ["n", "x", "y", *(["counters"] if key is not None else []), *measures.names]
        yield pa.RecordBatch.from_arrays(
            [pa.array([0], pa.int32()), *empty, *ends, pa.array([bad], pa.int64()), pa.array([example], pa.string())], names=names_out
        )

    doubles = pa.list_(pa.float64())
    measures = pa.schema([("low", doubles), ("high", doubles), ("bad", pa.int64()), ("example", pa.string())])
    more = ", counters binary" if key is not None else ""
    return rows.mapInArrow(run, f"{BLOCK_SCHEMA}{more}, {MEASURES}")


def block_measures(blocks: DataFrame) -> tuple[np.ndarray, np.ndarray, int, str | None]:
    """Smallest and largest values, the number of bad labels and an example, from the last rows of ``measured_blocks``.

    Two numbers per feature reach the driver, whatever the number of partitions; no bounds give empty arrays.
    """
    ends = blocks.where("n = 0").select("bad", "example", F.posexplode_outer(F.arrays_zip("low", "high")).alias("band", "b"))
    found = (
        ends.groupBy("band")
        .agg(F.min("b.low").alias("low"), F.max("b.high").alias("high"), F.sum("bad").alias("bad"), F.min("example").alias("example"))
        .orderBy("band")
        .collect()
    )
    bands = [r for r in found if r["band"] is not None]
    low, high = (np.array([r[c] for r in bands], dtype=np.float64) for c in ("low", "high"))
    return low, high, (found[0]["bad"] or 0) if found else 0, found[0]["example"] if found else None


@contextmanager
def staged_blocks(blocks: DataFrame, durable: bool = False) -> Iterator[DataFrame]:
    """Hold blocks for an iterative loop and release them afterwards.

    Blocks are kept in memory and spill to disk. A lost executor's blocks are recomputed from
    the input; with ``durable`` they are first written below ``spark.checkpoint.dir``, so that the
    recovery reads files instead of repeating the shuffles upstream. The files are deleted afterwards.
    """
    path = None
    if durable:
        spark = blocks.sparkSession
        path = scratch_path(spark, "blocks")
        blocks.write.parquet(path)
        blocks = spark.read.schema(blocks.schema).parquet(path)
    held = blocks.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield held
    finally:
        held.unpersist()
        if path is not None:
            delete_path(held.sparkSession, path)
