"""Sparse rows: blocks that hold only the entries that are not zero, and their products with dense matrices.

A sparse block is a row ``(n, x, y, lengths, positions)``: the entries of ``n`` rows end to end as doubles, the labels or
target vectors, how many entries each row has, and which feature each entry belongs to. Kernels see ``SparseRows``, which
take part in ``x @ matrix`` and ``matrix @ x`` like a dense matrix, so every loss works on either; what a product costs
follows the entries, not the width.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandnet.functions import feature_array
from bandnet.operators.arrow import matrix_from_lists, numbers_from_binary, packed_binary

SPARSE_BLOCK_SCHEMA = "n int, x binary, y binary, lengths binary, positions binary"


class SparseRows:
    """Rows in compressed form: the entries of row ``i`` are ``cuts[i]`` to ``cuts[i + 1]``."""

    __array_ufunc__ = None  # numpy leaves the operators below to this class

    def __init__(self, values: np.ndarray, positions: np.ndarray, cuts: np.ndarray, width: int) -> None:
        self.values, self.positions, self.cuts, self.shape = values, positions, cuts, (len(cuts) - 1, width)

    def __len__(self) -> int:
        return self.shape[0]

    def __getitem__(self, rows: slice) -> "SparseRows":
        start, stop, step = rows.indices(len(self))
        if step != 1:
            raise ValueError("rows are cut in stretches")
        stop = max(start, stop)
        low, high = self.cuts[start], self.cuts[stop]
        return SparseRows(self.values[low:high], self.positions[low:high], self.cuts[start : stop + 1] - low, self.shape[1])

    def where(self, keep: np.ndarray) -> "SparseRows":
        """The rows whose flag is set."""
        lengths = np.diff(self.cuts)
        entries = np.repeat(keep, lengths)
        cuts = np.concatenate([[0], np.cumsum(lengths[keep])])
        return SparseRows(self.values[entries], self.positions[entries], cuts, self.shape[1])

    @property
    def row(self) -> np.ndarray:
        """The row of every entry."""
        return np.repeat(np.arange(len(self)), np.diff(self.cuts))

    def toarray(self) -> np.ndarray:
        dense = np.zeros(self.shape)
        np.add.at(dense, (self.row, self.positions), self.values)
        return dense

    def __matmul__(self, matrix: np.ndarray) -> np.ndarray:
        """``x @ matrix``, a dense matrix with one row for every row."""
        if matrix.ndim == 1:
            return np.bincount(self.row, weights=self.values * matrix[self.positions], minlength=len(self))
        out = np.zeros((len(self), matrix.shape[1]))
        full = np.flatnonzero(np.diff(self.cuts))
        if len(full):
            out[full] = np.add.reduceat(self.values[:, None] * matrix[self.positions], self.cuts[full], axis=0)
        return out

    def __rmatmul__(self, matrix: np.ndarray) -> np.ndarray:
        """``matrix @ x``."""
        return np.ascontiguousarray((self.T @ np.ascontiguousarray(matrix.T)).T)

    def __rsub__(self, dense: np.ndarray) -> np.ndarray:
        """``dense - x``."""
        out = np.array(dense, dtype=np.float64)
        np.subtract.at(out, (self.row, self.positions), self.values)
        return out

    @property
    def T(self) -> "SparseColumns":
        return SparseColumns(self)


class SparseColumns:
    """The transpose of sparse rows, for products from the left."""

    __array_ufunc__ = None

    def __init__(self, rows: SparseRows) -> None:
        self.rows, self.shape = rows, rows.shape[::-1]

    def __matmul__(self, matrix: np.ndarray) -> np.ndarray:
        out = np.zeros((self.shape[0], *matrix.shape[1:]))
        self.add_product(matrix, out)
        return out

    def add_product(self, matrix: np.ndarray, out: np.ndarray) -> None:
        """Add ``x.T @ matrix`` to ``out``, touching only the features that have entries."""
        rows = self.rows
        shape = (-1,) + (1,) * (matrix.ndim - 1)
        np.add.at(out, rows.positions, rows.values.reshape(shape) * matrix[rows.row])


def sparse_entries(df: DataFrame, name: str) -> Column:
    """The entries of a feature column as a struct ``(indices, values)``, without making it dense.

    ML vectors, sparse or dense, and structs with these two fields are taken; a dense vector or an array has null indices.
    """
    kind = df.schema[name].dataType
    if isinstance(kind, VectorUDT):
        inside = F.unwrap_udt(name)
        return F.when(inside.isNotNull(), F.struct(inside["size"].alias("size"), inside["indices"].alias("indices"), inside["values"].alias("values")))
    if isinstance(kind, T.StructType) and {"indices", "values"} <= set(kind.names):
        return F.when(
            F.col(name).isNotNull(),
            F.struct(
                F.lit(None).cast("int").alias("size"),
                F.col(name)["indices"].cast("array<int>").alias("indices"),
                F.col(name)["values"].cast("array<double>").alias("values"),
            ),
        )
    values = feature_array(df, name).cast("array<double>")
    return F.when(
        values.isNotNull(), F.struct(F.size(values).alias("size"), F.lit(None).cast("array<int>").alias("indices"), values.alias("values"))
    )


def sparse_rows(column: pa.Array, width: int) -> SparseRows:
    """A column of ``sparse_entries`` as rows of ``width`` features; null rows and entries out of range are errors."""
    if column.null_count:
        raise ValueError("features must not be null")
    held = [column.field(name) for name in ("size", "indices", "values")]
    if held[2].null_count:
        raise ValueError("features must not be null")
    size = held[0].fill_null(width).to_numpy(zero_copy_only=False)
    if len(size) and not (size == width).all():
        raise ValueError(f"every feature vector must have {width} values")
    offsets = np.asarray(held[2].offsets).astype(np.int64)
    values = held[2].flatten()
    if values.null_count:
        raise ValueError("feature values must not be null")
    values = values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    dense = held[1].is_null().to_numpy(zero_copy_only=False)
    if dense.any() and not (lengths[dense] == width).all():
        raise ValueError(f"every feature vector must have {width} values")
    cuts = np.concatenate([[0], np.cumsum(lengths)])
    at_row = np.repeat(np.arange(len(lengths)), lengths)
    positions = np.arange(len(values)) - cuts[at_row]
    given = np.asarray(held[1].flatten().to_numpy(zero_copy_only=False))
    if len(given) != int(lengths[~dense].sum()) or held[1].flatten().null_count:
        raise ValueError("every value needs its index")
    positions[~dense[at_row]] = given
    if len(positions) and (positions.min() < 0 or positions.max() >= width):
        raise ValueError(f"feature index outside 0..{width - 1}")
    return SparseRows(values, positions, cuts, width)


def pack_sparse(width: int, block_size: int, with_label: bool, target_width: int = 0, counted: bool = False):
    """Batches of ``(features, label)`` or ``(features, target)`` to batches of sparse blocks, for one partition.

    A block of fewer than ``block_size`` rows ends every Arrow batch, not only the partition. With ``counted`` the last
    column of the rows is their counter.
    """
    each = target_width or int(with_label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = sparse_rows(batch.column(0), width)
            if target_width:
                y = matrix_from_lists(batch.column(1), target_width)
            else:
                y = batch.column(1).to_numpy(zero_copy_only=False) if with_label else np.empty(0)
            cuts = np.append(np.arange(0, len(x), block_size), len(x))
            columns = {
                "n": pa.array(np.diff(cuts).astype(np.int32)),
                "x": packed_binary(x.values.astype(np.float64), x.cuts[cuts]),
                "y": packed_binary(y, cuts * each),
                "lengths": packed_binary(np.diff(x.cuts), cuts),
                "positions": packed_binary(x.positions.astype(np.int32), x.cuts[cuts]),
            }
            if counted:
                columns["counters"] = packed_binary(batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False), cuts)
            yield pa.RecordBatch.from_pydict(columns)

    return run


def sparse_block_arrays(batch: pa.RecordBatch, width: int) -> tuple[SparseRows, np.ndarray, np.ndarray]:
    """A batch of sparse blocks as rows, their labels or target vectors, and the rows per block."""
    counts = np.asarray(batch.column(0))
    rows = int(counts.sum())
    lengths = numbers_from_binary(batch.column(3), rows).view(np.int64) if rows else np.empty(0, np.int64)
    cuts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    values = numbers_from_binary(batch.column(1), int(cuts[-1]))
    positions = numbers_from_binary(batch.column(4), int(cuts[-1]))
    positions = positions.view(np.int32) if len(positions) else np.empty(0, np.int32)
    labels = batch.column(2)
    each = len(labels[0].as_buffer() or b"") // (8 * int(counts[0])) if rows else 0
    y = numbers_from_binary(labels, rows * each)
    return SparseRows(values, positions, cuts, width), y.reshape(rows, each) if each > 1 else y, counts


def affine(df: DataFrame, layer: DataFrame, key: str = "id", features: str = "features", output: str = "output") -> DataFrame:
    """``(key, output)``: ``W x + b`` for weights in a table ``(input, output, value)``, a bias having input -1.

    A matrix product as a join on the input and a sum: no weight becomes a literal or passes through the driver, and
    Spark decides from the table's size whether to broadcast it. ``key`` is one per row. Arrays, dense vectors and
    sparse ones are taken, and of sparse ones only the entries are joined. Rows are dealt out by key before they are
    spread into entries, so the sums need no second shuffle where the weights are broadcast. ``output`` lists the
    outputs in ascending order, those without an entry at their bias. An entry whose input has no weight is an error;
    inputs that a row has no entry for count as 0; a row without features gives null.
    """
    weights = layer.select(F.col("input").cast("int").alias("input"), F.col("output").cast("int").alias("to"), F.col("value").cast("double").alias("w"))
    entries = sparse_entries(df, features)
    rows = df.select(F.col(key).alias("key"), entries.alias("e")).repartition("key")
    indices = F.coalesce(F.col("e.indices"), F.transform(F.col("e.values"), lambda v, i: i))
    # The bias is one more entry of every row, so that a row without entries has its outputs too
    pairs = F.arrays_zip(
        F.concat(F.array(F.lit(-1)), indices).alias("input"), F.concat(F.array(F.lit(1.0)), F.col("e.values")).alias("x")
    )
    spread = rows.select("key", F.inline_outer(F.when(F.col("e").isNotNull(), pairs)).alias("input", "x"))
    joined = spread.join(weights, "input", "left")
    lost = F.raise_error(F.concat(F.lit("no weight for input "), F.col("input").cast("string")))
    known = F.col("w").isNotNull() | F.col("input").isNull() | (F.col("input") == -1)
    sums = joined.select("key", "to", F.when(known, F.col("x") * F.col("w")).otherwise(lost).alias("product"))
    sums = sums.groupBy("key", "to").agg(F.sum("product").alias("v"))
    held = F.collect_list(F.when(F.col("to").isNotNull(), F.struct("to", "v")))
    out = sums.groupBy("key").agg(F.sort_array(held).alias("o"))
    return out.select(F.col("key").alias(key), F.when(F.size("o") > 0, F.col("o.v")).alias(output))
