"""Network topologies: layer lists, weight layout and initial weights.

A network is a list of layers ending in a loss layer. All weights live in one flat vector,
layer after layer; an affine layer holds its matrix with the output index running fastest,
then one bias per output.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import Column

from bandnet.functions import columns as C
from bandnet.functions import uniform_array


@dataclass(frozen=True)
class Activation:
    """An element-wise function, its derivative in terms of its own output, and its column form."""

    name: str
    fn: Callable[[np.ndarray], np.ndarray]
    derivative: Callable[[np.ndarray], np.ndarray]
    expression: Callable[[Column], Column] | None = None


def _relu(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0.0)


def _relu_slope(z: np.ndarray) -> np.ndarray:
    return (z > 0.0).astype(np.float64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    # exp of a non-positive number only, so that no input overflows
    e = np.exp(-np.abs(x))
    return np.where(x >= 0, 1.0, e) / (1.0 + e)


def _sigmoid_slope(z: np.ndarray) -> np.ndarray:
    return z * (1.0 - z)


RELU = Activation("relu", _relu, _relu_slope, C.relu)
SIGMOID = Activation("sigmoid", _sigmoid, _sigmoid_slope, C.sigmoid)


@dataclass(frozen=True)
class Affine:
    """``y = W x + b``."""

    inputs: int
    outputs: int

    def __post_init__(self) -> None:
        if self.inputs <= 0 or self.outputs <= 0:
            raise ValueError("layer sizes must be positive")

    @property
    def weight_count(self) -> int:
        return self.inputs * self.outputs + self.outputs


@dataclass(frozen=True)
class Elementwise:
    """A layer that applies an activation to every value."""

    activation: Activation
    weight_count: int = 0

    def expression(self, col: Column) -> Column:
        if self.activation.expression is None:
            raise ValueError(f"activation {self.activation.name!r} has no column form")
        return self.activation.expression(col)


@dataclass(frozen=True)
class SoftmaxCrossEntropy:
    """Softmax output scored by cross-entropy."""

    weight_count: int = 0

    def expression(self, col: Column) -> Column:
        return C.softmax(col)

    def output(self, z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def loss_and_delta(self, z: np.ndarray, target: np.ndarray) -> tuple[float, np.ndarray]:
        shifted = z - z.max(axis=1, keepdims=True)
        e = np.exp(shifted)
        total = e.sum(axis=1, keepdims=True)
        # log-probabilities straight from the logits: a zero probability gives no NaN
        loss = -float(np.sum(target * (shifted - np.log(total))))
        return loss, e / total - target


@dataclass(frozen=True)
class SquaredError:
    """Identity output scored by half the squared error."""

    weight_count: int = 0

    def expression(self, col: Column) -> Column:
        return col

    def output(self, z: np.ndarray) -> np.ndarray:
        return z

    def loss_and_delta(self, z: np.ndarray, target: np.ndarray) -> tuple[float, np.ndarray]:
        delta = z - target
        return 0.5 * float(np.vdot(delta, delta)), delta


@dataclass(frozen=True)
class SigmoidSquaredError:
    """Sigmoid output scored by half the squared error."""

    weight_count: int = 0

    def expression(self, col: Column) -> Column:
        return C.sigmoid(col)

    def output(self, z: np.ndarray) -> np.ndarray:
        return _sigmoid(z)

    def loss_and_delta(self, z: np.ndarray, target: np.ndarray) -> tuple[float, np.ndarray]:
        out = _sigmoid(z)
        delta = out - target
        return 0.5 * float(np.vdot(delta, delta)), delta * _sigmoid_slope(out)


LOSS_LAYERS = (SoftmaxCrossEntropy, SquaredError, SigmoidSquaredError)


@dataclass(frozen=True)
class Topology:
    """A layer list with a loss layer on top.

    ``target`` says what the output is compared with: the one-hot ``"label"``, the ``"input"``, or an array ``"column"``
    of as many values as the network has outputs.
    """

    layers: tuple[Any, ...]
    target: str = "label"

    def __post_init__(self) -> None:
        object.__setattr__(self, "layers", tuple(self.layers))
        if self.target not in ("label", "input", "column"):
            raise ValueError("target must be 'label', 'input' or 'column'")
        affine = [layer for layer in self.layers if isinstance(layer, Affine)]
        if not affine:
            raise ValueError("a network needs at least one affine layer")
        if not hasattr(self.layers[-1], "loss_and_delta"):
            raise ValueError("the top layer must carry a loss")
        if any(hasattr(layer, "loss_and_delta") for layer in self.layers[:-1]):
            raise ValueError("only the top layer may carry a loss")
        for before, after in zip(affine, affine[1:]):
            if before.outputs != after.inputs:
                raise ValueError(f"layer sizes do not fit: {before.outputs} then {after.inputs}")
        if self.target == "input" and self.inputs != self.outputs:
            raise ValueError(f"an autoencoder must end as wide as it starts: {self.inputs} and {self.outputs}")

    @classmethod
    def _dense(cls, sizes: Sequence[int], top: Any, hidden: Activation, target: str) -> "Topology":
        sizes = [int(s) for s in sizes]
        if len(sizes) < 2:
            raise ValueError("a network needs an input and an output size")
        layers: list[Any] = []
        for inputs, outputs in zip(sizes, sizes[1:]):
            layers += [Affine(inputs, outputs), Elementwise(hidden)]
        layers[-1] = top
        return cls(tuple(layers), target)

    @classmethod
    def classifier(cls, sizes: Sequence[int], hidden: Activation = RELU) -> "Topology":
        """ReLU hidden layers under a softmax output."""
        return cls._dense(sizes, SoftmaxCrossEntropy(), hidden, "label")

    @classmethod
    def autoencoder(cls, sizes: Sequence[int], hidden: Activation = RELU) -> "Topology":
        """ReLU hidden layers under an identity output that should equal the input."""
        return cls._dense(sizes, SquaredError(), hidden, "input")

    @classmethod
    def regressor(cls, sizes: Sequence[int], hidden: Activation = RELU, top: Any = SquaredError()) -> "Topology":
        """ReLU hidden layers under an output that should equal a target vector."""
        return cls._dense(sizes, top, hidden, "column")

    @property
    def inputs(self) -> int:
        return next(layer.inputs for layer in self.layers if isinstance(layer, Affine))

    @property
    def outputs(self) -> int:
        return next(layer.outputs for layer in reversed(self.layers) if isinstance(layer, Affine))

    @property
    def sizes(self) -> list[int]:
        affine = [layer for layer in self.layers if isinstance(layer, Affine)]
        return [affine[0].inputs] + [layer.outputs for layer in affine]

    @property
    def weight_count(self) -> int:
        return sum(layer.weight_count for layer in self.layers)

    @property
    def report_scale(self) -> float:
        """Factor from the optimised loss to the reported one.

        Squared error is reported per output value but optimised per row: the optimised form is
        the one whose true gradient is the back-propagated one.
        """
        return 1.0 / self.outputs if isinstance(self.layers[-1], SquaredError) else 1.0

    def check(self, weights: Sequence[float]) -> np.ndarray:
        """The weights as a flat float array; a wrong length is an error."""
        flat = np.ascontiguousarray(
            weights.toArray() if hasattr(weights, "toArray") else weights, dtype=np.float64
        )
        if flat.shape != (self.weight_count,):
            raise ValueError(f"expected {self.weight_count} weights but got {flat.size}")
        return flat

    def random_weights(self, seed: int) -> np.ndarray:
        """Uniform weights and biases within 2.4 / sqrt(inputs) of zero, layer by layer.

        Every weight comes from its position and the seed alone (``functions.counter``), so that numpy, Spark
        (``random_weight_frame``) and SQL give the same ones.
        """
        spread = uniform_array(np.arange(self.weight_count), seed) * 4.8 - 2.4
        for start, inputs, outputs in self.weight_coordinates():
            spread[start : start + inputs * outputs + outputs] /= np.sqrt(inputs)
        return spread

    def layer_weights(self, flat: np.ndarray) -> Iterator[tuple[Any, np.ndarray | None, np.ndarray | None]]:
        """Each layer with views of its matrix, shaped (inputs, outputs), and bias."""
        at = 0
        for layer in self.layers:
            if isinstance(layer, Affine):
                cells = layer.inputs * layer.outputs
                matrix = flat[at : at + cells].reshape(layer.inputs, layer.outputs)
                yield layer, matrix, flat[at + cells : at + layer.weight_count]
                at += layer.weight_count
            else:
                yield layer, None, None

    def weight_coordinates(self) -> list[tuple[int, int, int]]:
        """(first flat position, inputs, outputs) of every affine layer, in order."""
        found, at = [], 0
        for layer in self.layers:
            if isinstance(layer, Affine):
                found.append((at, layer.inputs, layer.outputs))
            at += layer.weight_count
        return found
