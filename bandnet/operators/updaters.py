"""Weight updates: how a gradient and a regulariser move the weights.

An updater is a function ``(w, gradient, step, iteration, reg) -> (new_w, penalty)`` where the
penalty is that of the new weights. Any function of this shape can be passed to the optimisers.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Updater = Callable[[np.ndarray, np.ndarray, float, int, float], tuple[np.ndarray, float]]


def constant_step(w, gradient, step, iteration, reg):
    """The same step at every iteration, no regulariser."""
    return w - step * gradient, 0.0


def simple_step(w, gradient, step, iteration, reg):
    """A step that shrinks with the square root of the iteration, no regulariser."""
    return w - step / np.sqrt(iteration) * gradient, 0.0


def l1_step(w, gradient, step, iteration, reg):
    """A shrinking step, then every weight pulled towards zero by the regulariser."""
    size = step / np.sqrt(iteration)
    moved = w - size * gradient
    moved = np.sign(moved) * np.maximum(np.abs(moved) - reg * size, 0.0)
    return moved, reg * float(np.abs(moved).sum())


def l2_step(w, gradient, step, iteration, reg):
    """A shrinking step along the gradient plus the ridge term."""
    size = step / np.sqrt(iteration)
    moved = (1.0 - size * reg) * w - size * gradient
    return moved, 0.5 * reg * float(moved @ moved)


def penalty(updater: Updater, w: np.ndarray, reg: float) -> tuple[float, np.ndarray]:
    """Value and gradient of the regulariser that an updater implies.

    A zero step leaves the weights alone and reports their penalty; a unit step without a data
    gradient moves them by the penalty's gradient.
    """
    zero = np.zeros_like(w)
    value = updater(w, zero, 0.0, 1, reg)[1]
    return value, w - updater(w, zero, 1.0, 1, reg)[0]
