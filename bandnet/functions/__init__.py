"""Column functions: everything here is a pure Spark expression."""

from bandnet.functions.columns import (
    affine,
    argmax,
    cross_entropy,
    dot,
    double_array_literal,
    elementwise,
    elementwise_pair,
    feature_array,
    let,
    matrix_literal,
    network_output,
    one_hot,
    relu,
    relu_grad,
    row_digest,
    sigmoid,
    sigmoid_grad,
    softmax,
    key_hash,
    split_bucket,
    squared_error,
)
from bandnet.functions.counter import (
    permuted_array,
    permuted_column,
    row_counter,
    sampled_array,
    sampled_column,
    uniform_array,
    uniform_column,
)

__all__ = [
    "affine",
    "argmax",
    "cross_entropy",
    "dot",
    "double_array_literal",
    "elementwise",
    "elementwise_pair",
    "feature_array",
    "let",
    "matrix_literal",
    "network_output",
    "one_hot",
    "relu",
    "relu_grad",
    "row_digest",
    "sigmoid",
    "sigmoid_grad",
    "softmax",
    "key_hash",
    "split_bucket",
    "squared_error",
    "permuted_array",
    "permuted_column",
    "row_counter",
    "sampled_array",
    "sampled_column",
    "uniform_array",
    "uniform_column",
]
