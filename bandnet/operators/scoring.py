"""Scoring: a forward pass over a table, as a column.

The network runs on Arrow batches with one matrix product per layer. Only the feature column
goes to Python and only the output comes back; the other columns stay in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandnet.functions import feature_array
from bandnet.operators.arrow import lists_from_matrix, matrix_from_lists
from bandnet.operators.losses import forward_outputs
from bandnet.operators.topology import Elementwise, Topology

CHUNK_ROWS = 4096


def _chunks(values: np.ndarray) -> Iterator[np.ndarray]:
    for start in range(0, len(values), CHUNK_ROWS):
        yield values[start : start + CHUNK_ROWS]


def network_column(
    df: DataFrame, topology: Topology, weights: Sequence[float], features: str, layer: int = -1, decode: bool = False
) -> Column:
    """One layer's output for every row as ``array<double>``, the last layer's by default.

    With ``decode`` the column is the position of the largest output instead, a double.
    """
    w = topology.check(weights)
    width = topology.inputs

    @F.arrow_udf("double" if decode else "array<double>")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            x = matrix_from_lists(batch, width)
            outputs = [forward_outputs(topology, w, part)[layer] for part in _chunks(x)]
            values = np.concatenate(outputs) if outputs else np.empty((0, topology.outputs))
            yield pa.array(values.argmax(axis=1).astype(np.float64)) if decode else lists_from_matrix(values)

    return score(feature_array(df, features, width))


def forward(
    df: DataFrame, topology: Topology, weights: Sequence[float], features: str = "features", output: str = "output"
) -> DataFrame:
    """Append the network's output."""
    return df.withColumn(output, network_column(df, topology, weights, features))


def forward_all(
    df: DataFrame, topology: Topology, weights: Sequence[float], features: str = "features", output: str = "outputs"
) -> DataFrame:
    """Append the output of every layer: an array with one array per layer."""
    w = topology.check(weights)
    width = topology.inputs

    @F.arrow_udf("array<array<double>>")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            x = matrix_from_lists(batch, width)
            outputs = forward_outputs(topology, w, x)
            sizes = np.array([o.shape[1] for o in outputs])
            inner = np.append(0, np.cumsum(np.tile(sizes, len(x))))
            flat = np.concatenate(outputs, axis=1).reshape(-1)
            lists = pa.ListArray.from_arrays(pa.array(inner.astype(np.int32)), pa.array(flat))
            outer = np.arange(len(x) + 1) * len(outputs)
            yield pa.ListArray.from_arrays(pa.array(outer.astype(np.int32)), lists)

    return df.withColumn(output, score(feature_array(df, features, width)))


def encode(
    df: DataFrame, topology: Topology, weights: Sequence[float], features: str = "features", output: str = "code"
) -> DataFrame:
    """Append the hidden code: the activated output of the narrowest hidden layer."""
    hidden = [i for i, layer in enumerate(topology.layers[:-1]) if isinstance(layer, Elementwise)]
    if not hidden:
        raise ValueError("the network has no hidden layer")
    widths, size = [], topology.inputs
    for layer in topology.layers:
        size = getattr(layer, "outputs", size)
        widths.append(size)
    narrowest = min(hidden, key=lambda i: widths[i])
    return df.withColumn(output, network_column(df, topology, weights, features, layer=narrowest))
