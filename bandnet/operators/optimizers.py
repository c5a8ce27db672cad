"""Optimisers: driver-side loops over a distributed objective.

Each step of a loop is one Spark job (``objective.evaluate``). The driver holds a few vectors
as long as the weights and nothing that grows with the table, and no plan grows from step to
step. An objective is any object with ``evaluate(w, fraction, seed)`` and ``report_scale``.
"""

from __future__ import annotations

import logging
import math
import sys
from collections.abc import Callable
from dataclasses import dataclass, field, fields
from typing import Protocol

import numpy as np

from bandnet.operators.objective import Evaluation
from bandnet.operators.updaters import Updater, constant_step, penalty, simple_step

log = logging.getLogger(__name__)

#: Told of every iteration: its number, its loss, and weights from which a run can be resumed
Progress = Callable[[int, float, np.ndarray], None]

SMALLEST_TOL = 5e-324
GRADIENT_FLOOR = 1e-8


class Objective(Protocol):
    report_scale: float

    def evaluate(self, w: np.ndarray, fraction: float = 1.0, seed: int | None = None) -> Evaluation: ...


class Optimizer(Protocol):
    """Anything that brings an objective down from a start; ``fit_network(solver=...)`` takes one in place of a name."""

    def optimize(self, objective: Objective, initial: np.ndarray) -> "Fit": ...


@dataclass
class Fit:
    """Final weights and the loss at every iteration, the first being that of the initial weights."""

    weights: np.ndarray
    history: list[float] = field(default_factory=list)
    evaluations: int = 0
    converged: bool = False
    #: Why the iterations ended
    reason: str = "iterations"
    #: Smallest and largest value of every feature, where the trainer scaled by them
    bounds: tuple[np.ndarray, np.ndarray] | None = None


@dataclass
class LbfgsState:
    """All that L-BFGS carries from one iteration to the next."""

    weights: np.ndarray
    gradient: np.ndarray
    loss: float
    history: list[float]
    #: Steps and changes of the gradient, the oldest first
    pairs: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    evaluations: int = 0

    @property
    def iteration(self) -> int:
        return len(self.history) - 1


def _check(condition: bool, message: str) -> None:
    if not condition:
        raise ValueError(message)


def minimize_gd(
    objective: Objective,
    initial: np.ndarray,
    updater: Updater = simple_step,
    step: float = 1.0,
    iterations: int = 100,
    reg: float = 0.0,
    fraction: float = 1.0,
    tol: float = 0.001,
    seed: int = 42,
    first_iteration: int = 1,
    on_iteration: Progress | None = None,
) -> Fit:
    """Minibatch gradient descent.

    Iteration ``i`` samples ``fraction`` of the objective's units without replacement under
    ``seed + i``, and records the batch loss plus the penalty, both at the weights it started
    from. It ends early once a step moves the weights by less than ``tol`` of their norm.
    ``on_iteration`` gets the weights after each step; a run resumed from those of iteration ``i``
    with ``first_iteration=i + 1`` has the step sizes and batches of one that was never cut.
    """
    _check(first_iteration >= 1, "first_iteration must be positive")
    _check(step > 0, "step must be positive")
    _check(iterations >= 0, "iterations must not be negative")
    _check(reg >= 0, "reg must not be negative")
    _check(0 < fraction <= 1, "fraction must be in (0, 1]")
    _check(0 <= tol <= 1, "tol must be in [0, 1]")
    if fraction < 1 and tol > 0:
        log.warning("a convergence tolerance can stop minibatch descent by chance")
    fit = Fit(np.array(initial, dtype=np.float64))
    penalty_value = updater(fit.weights, np.zeros_like(fit.weights), 0.0, 1, reg)[1]
    moved_before = False
    last = first_iteration + iterations - 1
    for i in range(first_iteration, last + 1):
        found = objective.evaluate(fit.weights, fraction, seed + i)
        fit.evaluations += 1
        if found.count == 0:
            if fraction >= 1.0:
                log.warning("no data: returning the initial weights")
                return fit
            log.warning("iteration %d of %d sampled nothing", i, last)
            continue
        _finite(found.loss, found.gradient, i)
        fit.history.append(found.loss * objective.report_scale + penalty_value)
        log.info("iteration %d: loss %.10g", i, fit.history[-1])
        before = fit.weights
        fit.weights, penalty_value = updater(before, found.gradient, step, i, reg)
        if on_iteration is not None:
            on_iteration(i, fit.history[-1], fit.weights.copy())
        moved = float(np.linalg.norm(fit.weights - before))
        if moved_before and moved < tol * max(float(np.linalg.norm(fit.weights)), 1.0):
            fit.converged, fit.reason = True, "the weights hardly moved"
            break
        moved_before = True
    return fit


def _finite(loss: float, gradient: np.ndarray, iteration: int) -> None:
    if not (math.isfinite(loss) and np.isfinite(gradient).all()):
        raise ValueError(f"loss {loss} or its gradient is not finite at iteration {iteration}; look for NaN or infinity in the data")


class _Line:
    """The objective along one direction, remembering its best point."""

    def __init__(self, value_at, w: np.ndarray, direction: np.ndarray, loss: float, slope: float) -> None:
        self.value_at, self.w, self.direction = value_at, w, direction
        self.start, self.slope = loss, slope
        self.best: tuple[float, np.ndarray, np.ndarray] | None = None

    def at(self, step: float) -> tuple[float, float]:
        point = self.w + step * self.direction
        loss, gradient = self.value_at(point)
        if not math.isfinite(loss):
            return math.inf, math.inf
        if loss < (self.start if self.best is None else self.best[0]):
            self.best = loss, point, gradient
        return loss, float(gradient @ self.direction)


def _cubic_minimum(a: float, fa: float, da: float, b: float, fb: float, db: float) -> float:
    """Minimum of the cubic through two points with slopes, kept well inside the interval."""
    low, high = min(a, b), max(a, b)
    middle = 0.5 * (a + b)
    if not (math.isfinite(fb) and math.isfinite(db)):
        return middle
    theta = da + db - 3.0 * (fb - fa) / (b - a)
    square = theta * theta - da * db
    if square < 0:
        return middle
    root = math.copysign(math.sqrt(square), b - a)
    below = db - da + 2.0 * root
    if below == 0:
        return middle
    guess = b - (b - a) * (db + root - theta) / below
    margin = 0.1 * (high - low)
    return guess if low + margin <= guess <= high - margin else middle


def _strong_wolfe(line: _Line, step: float, c1: float = 1e-4, c2: float = 0.9, limit: int = 20) -> bool:
    """Search for a step with enough decrease and a flat enough slope; True when found."""
    last, last_loss, last_slope = 0.0, line.start, line.slope
    for tries in range(limit):
        loss, slope = line.at(step)
        if loss > line.start + c1 * step * line.slope or (tries and loss >= last_loss):
            low, high = (last, last_loss, last_slope), (step, loss, slope)
        elif abs(slope) <= -c2 * line.slope:
            return True
        elif slope >= 0:
            low, high = (step, loss, slope), (last, last_loss, last_slope)
        else:
            last, last_loss, last_slope = step, loss, slope
            step *= 2.0
            continue
        break
    else:
        return False
    for _ in range(limit - tries):
        if abs(high[0] - low[0]) <= 1e-12 * max(abs(low[0]), abs(high[0])):
            return False
        step = _cubic_minimum(*low, *high)
        loss, slope = line.at(step)
        if loss > line.start + c1 * step * line.slope or loss >= low[1]:
            high = (step, loss, slope)
        elif abs(slope) <= -c2 * line.slope:
            return True
        else:
            if slope * (high[0] - low[0]) >= 0:
                high = low
            low = (step, loss, slope)
    return False


def _direction(gradient: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray, float]]) -> np.ndarray:
    """Minus the inverse curvature times the gradient, from the stored corrections."""
    out = -gradient
    factors = []
    for s, y, rho in reversed(pairs):
        factor = rho * float(s @ out)
        out = out - factor * y
        factors.append(factor)
    if pairs:
        s, y, _ = pairs[-1]
        out = out * (float(s @ y) / float(y @ y))
    for (s, y, rho), factor in zip(pairs, reversed(factors)):
        out = out + (factor - rho * float(y @ out)) * s
    return out


def minimize_lbfgs(
    objective: Objective,
    initial: np.ndarray,
    updater: Updater = constant_step,
    corrections: int = 10,
    tol: float = SMALLEST_TOL,
    iterations: int = 100,
    reg: float = 0.0,
    gradient_floor: float = GRADIENT_FLOOR,
    on_iteration: Progress | None = None,
    resume: LbfgsState | None = None,
    on_state: Callable[[LbfgsState], None] | None = None,
) -> Fit:
    """Limited-memory BFGS with a strong-Wolfe line search.

    The regulariser is the one the updater implies. Iterations end at ``iterations``, when the
    gradient or the relative decrease falls to ``tol``, when the gradient's norm falls to
    ``gradient_floor`` (whatever ``tol`` says; 0 switches this off), or when no step lowers the loss;
    ``Fit.reason`` says which. A start that is not finite is an error. ``on_iteration`` gets the
    weights of every iteration; a run started from them loses the stored curvature only. ``on_state`` gets all that
    the next iteration needs; a run with ``resume`` takes ``initial`` from it, goes on to the same ``iterations`` and
    has the weights and the history of one that was never cut, to the bit (``operators.restart`` keeps states in
    a table).
    """
    _check(gradient_floor >= 0, "gradient_floor must not be negative")
    _check(corrections > 0, "corrections must be positive")
    _check(tol >= 0, "tol must not be negative")
    _check(iterations >= 0, "iterations must not be negative")
    _check(reg >= 0, "reg must not be negative")
    fit = Fit(np.array(initial, dtype=np.float64))
    counts = []
    scale = objective.report_scale

    def value_at(w: np.ndarray) -> tuple[float, np.ndarray]:
        found = objective.evaluate(w)
        fit.evaluations += 1
        counts.append(found.count)
        value, slope = penalty(updater, w, reg)
        # searched: optimised loss plus penalty, the sum whose gradient this is
        return found.loss + value, found.gradient + slope

    def reported(value: float, w: np.ndarray) -> float:
        if scale == 1.0:
            return value
        extra = penalty(updater, w, reg)[0]
        return (value - extra) * scale + extra

    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    if resume is None:
        loss, gradient = value_at(fit.weights)
        if counts[0] == 0:
            log.warning("no data: returning the initial weights")
            return fit
        _finite(loss, gradient, 0)
        fit.history.append(reported(loss, fit.weights))
    else:
        _check(resume.weights.shape == fit.weights.shape, f"the state has {resume.weights.size} weights, not {fit.weights.size}")
        fit.weights, gradient, loss = resume.weights.copy(), resume.gradient.copy(), resume.loss
        fit.history, fit.evaluations = list(resume.history), resume.evaluations
        pairs = [(s, y, 1.0 / float(s @ y)) for s, y in resume.pairs[-corrections:]]
    for _ in range(len(fit.history) - 1, iterations):
        size = float(np.linalg.norm(gradient))
        if size <= max(tol * abs(loss), gradient_floor):
            fit.converged, fit.reason = True, "the gradient is small"
            break
        direction = _direction(gradient, pairs)
        slope = float(gradient @ direction)
        if slope >= 0:
            pairs, direction, slope = [], -gradient, -size * size
        line = _Line(value_at, fit.weights, direction, loss, slope)
        _strong_wolfe(line, 1.0 if pairs else 1.0 / size)
        if line.best is None and pairs:
            # stale curvature: forget it and try steepest descent once
            pairs = []
            line = _Line(value_at, fit.weights, -gradient, loss, -size * size)
            _strong_wolfe(line, 1.0 / size)
        if line.best is None:
            fit.reason = "no step lowers the loss"
            log.info("iteration %d: %s", len(fit.history), fit.reason)
            break
        new_loss, point, new_gradient = line.best
        s, y = point - fit.weights, new_gradient - gradient
        curvature = float(s @ y)
        if curvature > sys.float_info.epsilon * float(y @ y):
            pairs = (pairs + [(s, y, 1.0 / curvature)])[-corrections:]
        change = loss - new_loss
        fit.weights, loss, gradient = point, new_loss, new_gradient
        fit.history.append(reported(loss, fit.weights))
        log.info("iteration %d: loss %.10g", len(fit.history) - 1, fit.history[-1])
        if on_iteration is not None:
            on_iteration(len(fit.history) - 1, fit.history[-1], fit.weights.copy())
        if on_state is not None:
            on_state(LbfgsState(fit.weights, gradient, loss, list(fit.history), [(s, y) for s, y, _ in pairs], fit.evaluations))
        if change <= tol * max(abs(loss), abs(loss + change)):
            fit.converged, fit.reason = True, "the loss hardly fell"
            break
    return fit


@dataclass(frozen=True)
class Lbfgs:
    """``minimize_lbfgs`` with its settings, as an optimizer."""

    updater: Updater = constant_step
    corrections: int = 10
    tol: float = SMALLEST_TOL
    iterations: int = 100
    reg: float = 0.0
    gradient_floor: float = GRADIENT_FLOOR
    on_iteration: Progress | None = None
    resume: LbfgsState | None = None
    on_state: Callable[[LbfgsState], None] | None = None

    def optimize(self, objective: Objective, initial: np.ndarray) -> Fit:
        return minimize_lbfgs(objective, initial, **{f.name: getattr(self, f.name) for f in fields(self)})


@dataclass(frozen=True)
class GradientDescent:
    """``minimize_gd`` with its settings, as an optimizer."""

    updater: Updater = simple_step
    step: float = 1.0
    iterations: int = 100
    reg: float = 0.0
    fraction: float = 1.0
    tol: float = 0.001
    seed: int = 42
    first_iteration: int = 1
    on_iteration: Progress | None = None

    def optimize(self, objective: Objective, initial: np.ndarray) -> Fit:
        return minimize_gd(objective, initial, **{f.name: getattr(self, f.name) for f in fields(self)})
