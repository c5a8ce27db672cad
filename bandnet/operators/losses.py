"""Losses: what one chunk of rows adds to the objective and its gradient.

A loss is any object with

* ``weight_count(width)``: how many weights it has for ``width`` features,
* ``partial(x, y, w) -> (loss_sum, gradient_sum)`` over the rows of a chunk, ``x`` being a matrix or, for sparse blocks,
  ``sparse.SparseRows`` (``x @ matrix``, ``x.T @ matrix``, ``matrix @ x``, ``toarray()``),
* ``report_scale``: factor from the optimised loss to the reported one,
* ``with_label``: whether ``y`` holds labels,
* ``with_target`` (may be absent): whether ``y`` holds target vectors.

Spark runs ``partial`` on every partition and adds the results (see ``operators.objective``).
Linear losses have a column form too, which needs no Python worker.
"""

from __future__ import annotations

from typing import Protocol

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from bandnet.operators.topology import Affine, Topology


class Loss(Protocol):
    report_scale: float
    with_label: bool

    def weight_count(self, width: int) -> int: ...

    def partial(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]: ...


def forward_outputs(topology: Topology, w: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
    """The output of every layer; the loss layer's entry is the network's output."""
    outputs, value = [], x
    for layer, matrix, bias in topology.layer_weights(w):
        if matrix is not None:
            value = value @ matrix + bias
        elif hasattr(layer, "loss_and_delta"):
            value = layer.output(value)
        else:
            value = layer.activation.fn(value)
        outputs.append(value)
    return outputs


class NetworkLoss:
    """Back-propagated loss and gradient of a network."""

    def __init__(self, topology: Topology) -> None:
        self.topology = topology
        self.report_scale = topology.report_scale
        self.with_label = topology.target == "label"
        self.with_target = topology.target == "column"

    def weight_count(self, width: int) -> int:
        if width != self.topology.inputs:
            raise ValueError(f"the network takes {self.topology.inputs} features, not {width}")
        return self.topology.weight_count

    def _target(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        topology = self.topology
        if self.with_label:
            sound = (y >= 0) & (y < topology.outputs) & (y == np.floor(y))
            if not sound.all():
                raise ValueError(f"label outside 0..{topology.outputs - 1}: {y[~sound][0]}")
            target = np.zeros((len(x), topology.outputs))
            target[np.arange(len(x)), y.astype(np.int64)] = 1.0
        elif self.with_target:
            target = y.reshape(len(x), topology.outputs)
            if not np.isfinite(target).all():
                raise ValueError("target values must be finite")
        else:
            target = x
        return target

    def value(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
        """The loss alone: one pass forward."""
        topology = self.topology
        target, value = self._target(x, y), x
        for layer, matrix, bias in list(topology.layer_weights(w))[:-1]:
            value = value @ matrix + bias if matrix is not None else layer.activation.fn(value)
        return topology.layers[-1].loss_and_delta(value, target)[0]

    def partial(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
        topology = self.topology
        target = self._target(x, y)
        views = list(topology.layer_weights(w))
        values = [x]
        for layer, matrix, bias in views[:-1]:
            values.append(values[-1] @ matrix + bias if matrix is not None else layer.activation.fn(values[-1]))
        loss, delta = topology.layers[-1].loss_and_delta(values[-1], target)
        gradient = np.empty_like(w)
        slots = list(topology.layer_weights(gradient))
        for at in range(len(views) - 2, -1, -1):
            layer, matrix, _ = views[at]
            if matrix is None:
                delta = delta * layer.activation.derivative(values[at + 1])
                continue
            if isinstance(values[at], np.ndarray):
                np.matmul(values[at].T, delta, out=slots[at][1])
            else:
                slots[at][1][:] = values[at].T @ delta
            slots[at][2][:] = delta.sum(axis=0)
            if any(isinstance(below, Affine) for below in topology.layers[:at]):
                delta = delta @ matrix.T
            else:
                break
        return loss, gradient


class ScaledLoss:
    """A loss on features mapped to [0, 1] by their bounds, chunk by chunk; a feature with equal bounds becomes 0.5."""

    def __init__(self, loss: Loss, low: np.ndarray, high: np.ndarray) -> None:
        self.loss, self.low = loss, np.asarray(low, dtype=np.float64)
        self.flat = np.asarray(high) == self.low
        self.span = np.where(self.flat, 1.0, np.asarray(high) - self.low)
        self.report_scale, self.with_label = loss.report_scale, loss.with_label
        self.with_target = getattr(loss, "with_target", False)

    def weight_count(self, width: int) -> int:
        return self.loss.weight_count(width)

    def partial(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
        x = (x - self.low) / self.span
        if self.flat.any():
            x[:, self.flat] = 0.5
        return self.loss.partial(x, y, w)


class LinearLoss:
    """A loss of one or more linear margins ``x . w_k``, without intercept.

    Subclasses give the loss and its slope in each margin, once for numpy and once for columns;
    the gradient is then the slope-weighted sum of the features.
    """

    margins = 1
    report_scale = 1.0
    with_label = True

    def weight_count(self, width: int) -> int:
        return self.margins * width

    def values(self, m: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def columns(self, m: list[Column], y: Column) -> tuple[Column, list[Column]]:
        raise NotImplementedError

    def partial(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
        loss, slopes = self.values(x @ w.reshape(self.margins, -1).T, y)
        return float(loss.sum()), (slopes.T @ x).reshape(-1)


class LogisticLoss(LinearLoss):
    """Binary logistic loss for labels 0 and 1."""

    def values(self, m, y):
        m = m[:, 0]
        loss = np.logaddexp(0.0, -m) + np.where(y > 0, 0.0, m)
        e = np.exp(-np.abs(m))
        return loss, (np.where(m >= 0, 1.0, e) / (1.0 + e) - y)[:, None]

    def columns(self, m, y):
        margin = m[0]
        small = F.exp(-F.abs(margin))
        loss = F.greatest(-margin, F.lit(0.0)) + F.log1p(small) + F.when(y > 0, F.lit(0.0)).otherwise(margin)
        chance = F.when(margin >= 0, F.lit(1.0)).otherwise(small) / (small + 1.0)
        return loss, [chance - y]


class MultinomialLoss(LinearLoss):
    """Multinomial logistic loss with class 0 as the pivot: ``classes - 1`` margins."""

    def __init__(self, classes: int) -> None:
        if classes < 2:
            raise ValueError("a multinomial loss needs at least two classes")
        self.margins = classes - 1

    def values(self, m, y):
        top = np.maximum(m.max(axis=1), 0.0)
        e = np.exp(m - top[:, None])
        total = e.sum(axis=1) + np.exp(-top)
        hit = np.equal(y[:, None], np.arange(1, self.margins + 1))
        return np.log(total) + top - (m * hit).sum(axis=1), e / total[:, None] - hit

    def columns(self, m, y):
        top = F.greatest(F.lit(0.0), F.lit(0.0), *m)
        e = [F.exp(v - top) for v in m]
        total = F.exp(-top)
        for v in e:
            total = total + v
        hits = [(y == F.lit(float(k + 1))).cast("double") for k in range(self.margins)]
        own = F.lit(0.0)
        for v, hit in zip(m, hits):
            own = own + v * hit
        return F.log(total) + top - own, [v / total - hit for v, hit in zip(e, hits)]


class LeastSquaresLoss(LinearLoss):
    """Half the squared residual."""

    def values(self, m, y):
        diff = m[:, 0] - y
        return diff * diff / 2.0, diff[:, None]

    def columns(self, m, y):
        diff = m[0] - y
        return diff * diff / 2.0, [diff]


class HingeLoss(LinearLoss):
    """Hinge loss for labels 0 and 1."""

    def values(self, m, y):
        sign = 2.0 * y - 1.0
        gap = 1.0 - sign * m[:, 0]
        return np.maximum(gap, 0.0), np.where(gap > 0, -sign, 0.0)[:, None]

    def columns(self, m, y):
        sign = y * 2.0 - 1.0
        gap = F.lit(1.0) - sign * m[0]
        return F.greatest(gap, F.lit(0.0)), [F.when(gap > 0, -sign).otherwise(F.lit(0.0))]
