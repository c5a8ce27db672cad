"""Neural-network building blocks as Spark column expressions.

These run inside the JVM and need no Python worker, so they suit labels, activations and
small networks. Wide networks are scored by the Arrow kernel in ``operators.scoring``; the
two agree to rounding and the tests hold them to that.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ColumnOrName = Column | str


def _col(value: ColumnOrName) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def _double_text(value: float) -> str:
    if not math.isfinite(value):
        raise ValueError(f"weights must be finite, got {value}")
    return f"{float(value)!r}D"


def _row_text(values: Sequence[float]) -> str:
    return "array(" + ",".join(_double_text(v) for v in values) + ")"


def double_array_literal(values: Sequence[float]) -> Column:
    """An ``array<double>`` constant; Catalyst folds it to one literal."""
    return F.expr(_row_text(values))


#: Most weights that an expression may hold as text; more go through ``operators.affine`` or the scoring kernel
LITERAL_LIMIT = 50_000


def matrix_literal(rows: Sequence[Sequence[float]]) -> Column:
    """An ``array<array<double>>`` constant, one inner array per row."""
    return F.expr("array(" + ",".join(_row_text(r) for r in rows) + ")")


def feature_array(df: DataFrame, name: str, width: int | None = None) -> Column:
    """The feature column as an array of floats or doubles.

    ML vectors become ``array<double>``. Float and double arrays pass through untouched:
    widening a float array in the JVM would double what is later sent to Python. With ``width``
    a row that is null or of another length is an error.
    """
    values = _feature_array(df, name)
    if width is None:
        return values
    problem = F.concat(F.lit(f"column {name} needs {width} values, found "), F.coalesce(F.size(values).cast("string"), F.lit("null")))
    return F.when(F.size(values) == width, values).otherwise(F.raise_error(problem))


def _feature_array(df: DataFrame, name: str) -> Column:
    dtype = df.schema[name].dataType
    if isinstance(dtype, VectorUDT):
        return vector_to_array(F.col(name))
    if isinstance(dtype, T.ArrayType):
        if isinstance(dtype.elementType, (T.FloatType, T.DoubleType)):
            return F.col(name)
        return F.col(name).cast("array<double>")
    raise TypeError(f"column {name!r} must hold vectors or numeric arrays, not {dtype.simpleString()}")


def elementwise(col: ColumnOrName, fn: Callable[[Column], Column]) -> Column:
    """Apply ``fn`` to every element of an array column."""
    return F.transform(_col(col), fn)


def elementwise_pair(
    left: ColumnOrName, right: ColumnOrName, fn: Callable[[Column, Column], Column]
) -> Column:
    """Apply ``fn`` to the aligned elements of two array columns."""
    return F.zip_with(_col(left), _col(right), fn)


def dot(left: ColumnOrName, right: ColumnOrName) -> Column:
    """Inner product of two array columns."""
    return F.aggregate(
        F.zip_with(_col(left), _col(right), lambda a, b: a * b),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )


def affine(col: ColumnOrName, weights: np.ndarray, bias: np.ndarray) -> Column:
    """``W x + b`` for a constant ``W`` of shape (outputs, inputs)."""
    weights = np.asarray(weights, dtype=float)
    bias = np.asarray(bias, dtype=float)
    if weights.ndim != 2 or bias.shape != (weights.shape[0],):
        raise ValueError("affine needs a matrix of (outputs, inputs) and one bias per output")
    if weights.size > LITERAL_LIMIT:
        raise ValueError(f"{weights.size} weights are too many for an expression: use operators.affine over a weight table")
    return let(
        _col(col).cast("array<double>"),
        lambda x: F.zip_with(
            matrix_literal(weights), double_array_literal(bias), lambda row, b: dot(row, x) + b
        ),
    )


def relu(col: ColumnOrName) -> Column:
    """``x`` where positive, else 0."""
    return elementwise(col, lambda x: F.greatest(x, F.lit(0.0)))


def relu_grad(col: ColumnOrName) -> Column:
    """Derivative of ReLU, taken from its output: 1 where positive, else 0."""
    return elementwise(col, lambda z: F.when(z > 0, F.lit(1.0)).otherwise(F.lit(0.0)))


def sigmoid(col: ColumnOrName) -> Column:
    """``1 / (1 + exp(-x))``."""
    return elementwise(col, lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-x)))


def sigmoid_grad(col: ColumnOrName) -> Column:
    """Derivative of the sigmoid, taken from its output: ``(1 - z) z``."""
    return elementwise(col, lambda z: (F.lit(1.0) - z) * z)


def softmax(col: ColumnOrName) -> Column:
    """Softmax shifted by the largest element, so large inputs stay finite."""
    return let(
        _col(col),
        lambda x: let(
            let(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp(v - top))),
            lambda e: let(
                F.aggregate(e, F.lit(0.0), lambda acc, v: acc + v),
                lambda total: F.transform(e, lambda v: v / total),
            ),
        ),
    )


def one_hot(label: ColumnOrName, size: int) -> Column:
    """A label as ``size`` slots with 1.0 at the label; a label out of range is an error."""
    value = _col(label)
    return F.when(
        (value >= 0) & (value < size) & (value == F.floor(value)),
        F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (i == value.cast("int")).cast("double")),
    ).otherwise(
        F.raise_error(F.concat(F.lit(f"label outside 0..{size - 1}: "), F.coalesce(value.cast("string"), F.lit("null"))))
    )


def argmax(col: ColumnOrName) -> Column:
    """Position of the largest element as a double; the first one on ties."""
    return let(_col(col), lambda p: (F.array_position(p, F.array_max(p)) - 1).cast("double"))


def squared_error(left: ColumnOrName, right: ColumnOrName) -> Column:
    """Sum of squared differences of two array columns."""
    return F.aggregate(
        F.zip_with(_col(left), _col(right), lambda a, b: (a - b) * (a - b)),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )


def cross_entropy(probability: ColumnOrName, label: ColumnOrName) -> Column:
    """``-log p[label]`` for a row of class probabilities: infinity where that probability is 0.

    A label that is null, fractional or no class of the row is an error, as is a null probability.
    """
    classes, value = F.size(_col(probability)), _col(label).cast("double")
    sound = (value >= 0) & (value < classes) & (value == F.floor(value))
    p = F.get(_col(probability), F.when(sound, value.cast("int")).otherwise(F.lit(-1)))
    problem = F.concat(
        F.lit("no probability for label "), F.coalesce(value.cast("string"), F.lit("null")), F.lit(" among "), F.coalesce(classes, F.lit(0)).cast("string")
    )
    return F.when(p > 0, -F.log(p)).when(p == 0, F.lit(float("inf"))).otherwise(F.raise_error(problem))


KEY_HASH_BITS = 60


def key_hash(key: ColumnOrName, salt: str) -> Column:
    """A number of 60 bits that depends on the key and the salt alone; a null key is an error.

    It does not depend on row order, file layout or partition count, so a split by it can be
    repeated on any cluster and recomputed safely after a lost executor.
    """
    digest = F.md5(F.concat(F.lit(f"{salt}:"), _col(key).cast("string")).cast("binary"))
    number = F.conv(F.substring(digest, 1, KEY_HASH_BITS // 4), 16, 10).cast("bigint")
    return F.when(_col(key).isNull(), F.raise_error(F.lit("a split key must not be null"))).otherwise(number)


def row_digest(df: DataFrame) -> Column:
    """A digest of all columns of a row as text; equal rows have equal ones, whatever the layout of the table."""

    def text(field: T.StructField) -> Column:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, VectorUDT):
            col = F.unwrap_udt(col)
        shown = F.hex(col) if isinstance(field.dataType, T.BinaryType) else col.cast("string")
        return F.coalesce(shown, F.lit("\x00"))

    return F.md5(F.concat_ws("\x1f", *[text(f) for f in df.schema.fields]).cast("binary"))


def split_bucket(key: ColumnOrName, salt: str) -> Column:
    """A bucket in 0..999 by the key's hash."""
    return (key_hash(key, salt) % 1000).cast("int")


def network_output(col: ColumnOrName, topology, weights: np.ndarray) -> Column:
    """A whole forward pass as one expression, for small networks without a Python worker."""
    out = _col(col).cast("array<double>")
    for layer, matrix, bias in topology.layer_weights(weights):
        out = affine(out, matrix.T, bias) if matrix is not None else layer.expression(out)
    return out
