import numpy as np
import pytest

from bandnet.operators import (
    ColumnObjective,
    LeastSquaresLoss,
    constant_step,
    l1_step,
    l2_step,
    minimize_gd,
    minimize_lbfgs,
    penalty,
    simple_step,
)
from bandnet.operators.objective import Evaluation


class Local:
    """An objective on the driver, for testing the loops alone."""

    report_scale = 1.0

    def __init__(self, fn, count=1):
        self.fn, self.count, self.calls = fn, count, []

    def evaluate(self, w, fraction=1.0, seed=None):
        self.calls.append((fraction, seed))
        loss, gradient = self.fn(w)
        return Evaluation(loss, gradient, self.count)


def bowl(center, scale):
    return lambda w: (0.5 * float(np.sum(scale * (w - center) ** 2)), scale * (w - center))


def rosenbrock(w):
    a, b = w
    return (1 - a) ** 2 + 100 * (b - a * a) ** 2, np.array([-2 * (1 - a) - 400 * a * (b - a * a), 200 * (b - a * a)])


CENTER, SCALE = np.array([1.0, -2.0, 3.0]), np.array([1.0, 10.0, 0.1])


def test_lbfgs_finds_minima():
    fit = minimize_lbfgs(Local(bowl(CENTER, SCALE)), np.zeros(3))
    np.testing.assert_allclose(fit.weights, CENTER, atol=1e-6)
    assert fit.history == sorted(fit.history, reverse=True)
    fit = minimize_lbfgs(Local(rosenbrock), np.array([-1.2, 1.0]), iterations=200)
    np.testing.assert_allclose(fit.weights, [1, 1], atol=1e-6)
    assert fit.evaluations < 100


def test_lbfgs_with_ridge_and_lasso():
    reg = 0.5
    fit = minimize_lbfgs(Local(bowl(CENTER, SCALE)), np.zeros(3), l2_step, reg=reg)
    np.testing.assert_allclose(fit.weights, SCALE * CENTER / (SCALE + reg), atol=1e-6)
    value, slope = penalty(l1_step, np.array([2.0, -0.2, 0.0]), reg)
    assert value == pytest.approx(1.1)
    np.testing.assert_allclose(slope, [0.5, -0.2, 0.0])
    value, slope = penalty(l2_step, np.array([2.0, -1.0]), reg)
    assert value == pytest.approx(1.25)
    np.testing.assert_allclose(slope, [1.0, -0.5])
    for plain in (constant_step, simple_step):
        value, slope = penalty(plain, np.array([2.0, -1.0]), reg)
        assert value == 0 and not slope.any()


def test_lbfgs_limits():
    assert len(minimize_lbfgs(Local(rosenbrock), np.array([-1.2, 1.0]), iterations=3).history) == 4
    assert len(minimize_lbfgs(Local(rosenbrock), np.array([-1.2, 1.0]), iterations=0).history) == 1
    early = minimize_lbfgs(Local(rosenbrock), np.array([-1.2, 1.0]), tol=0.5)
    assert early.converged and len(early.history) < 10
    done = minimize_lbfgs(Local(bowl(CENTER, SCALE)), CENTER)
    assert done.converged and done.evaluations == 1
    empty = minimize_lbfgs(Local(bowl(CENTER, SCALE), count=0), np.ones(3))
    np.testing.assert_array_equal(empty.weights, np.ones(3))


def test_lbfgs_survives_a_wall_and_a_kink():
    def walled(w):
        if w[0] > 2:
            return float("inf"), np.array([np.nan])
        return float((w[0] - 1.9) ** 2), 2 * (w - 1.9)

    assert abs(minimize_lbfgs(Local(walled), np.array([-50.0])).weights[0] - 1.9) < 1e-6
    kink = minimize_lbfgs(Local(lambda w: (float(np.abs(w).sum()), np.sign(w))), np.array([3.0, -2.0]))
    assert kink.history[-1] < kink.history[0]


def test_descent_follows_its_updater():
    for updater in (constant_step, simple_step, l1_step, l2_step):
        fit = minimize_gd(Local(bowl(CENTER, SCALE)), np.ones(3), updater, 0.05, 4, 0.3, tol=0.0)
        w, history = np.ones(3), []
        extra = updater(w, np.zeros(3), 0.0, 1, 0.3)[1]
        for i in range(1, 5):
            loss, gradient = bowl(CENTER, SCALE)(w)
            history.append(loss + extra)
            w, extra = updater(w, gradient, 0.05, i, 0.3)
        np.testing.assert_allclose(fit.weights, w)
        np.testing.assert_allclose(fit.history, history)


def test_updater_formulas():
    w, g = np.array([1.0, -0.1]), np.array([0.5, 0.0])
    np.testing.assert_allclose(constant_step(w, g, 0.2, 4, 9.0)[0], [0.9, -0.1])
    np.testing.assert_allclose(simple_step(w, g, 0.2, 4, 9.0)[0], [0.95, -0.1])
    moved, value = l1_step(w, g, 0.2, 4, 2.0)
    np.testing.assert_allclose(moved, [0.75, 0.0])
    assert value == pytest.approx(1.5)
    moved, value = l2_step(w, g, 0.2, 4, 2.0)
    np.testing.assert_allclose(moved, [0.75, -0.08])
    assert value == pytest.approx(0.75**2 + 0.08**2)


def test_descent_convergence_and_sampling():
    fit = minimize_gd(Local(bowl(CENTER, np.ones(3))), CENTER + 1e-5, constant_step, 0.1, 50)
    assert fit.converged and len(fit.history) == 2
    local = Local(bowl(CENTER, SCALE))
    minimize_gd(local, np.ones(3), constant_step, 0.01, 3, fraction=0.5, tol=0.0)
    assert local.calls == [(0.5, 43), (0.5, 44), (0.5, 45)]
    empty = Local(bowl(CENTER, SCALE), count=0)
    assert minimize_gd(empty, np.ones(3), constant_step).history == [] and len(empty.calls) == 1
    skipping = Local(bowl(CENTER, SCALE), count=0)
    minimize_gd(skipping, np.ones(3), constant_step, iterations=3, fraction=0.5, tol=0.0)
    assert len(skipping.calls) == 3


@pytest.mark.parametrize(
    "options", [{"step": 0}, {"fraction": 0}, {"fraction": 1.5}, {"tol": 2}, {"tol": -1}, {"iterations": -1}, {"reg": -1}]
)
def test_descent_settings_are_checked(options):
    with pytest.raises(ValueError):
        minimize_gd(Local(rosenbrock), np.zeros(2), **options)


@pytest.mark.parametrize("options", [{"corrections": 0}, {"tol": -1}, {"iterations": -1}, {"reg": -1}])
def test_lbfgs_settings_are_checked(options):
    with pytest.raises(ValueError):
        minimize_lbfgs(Local(rosenbrock), np.zeros(2), **options)


def test_column_objective_over_a_table(spark):
    gen = np.random.default_rng(1)
    x = gen.normal(size=(50, 2))
    y = x @ [2.0, -1.0]
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, t double")
    objective = ColumnObjective(df, ["a", "b"], "t", LeastSquaresLoss())
    np.testing.assert_allclose(minimize_lbfgs(objective, np.zeros(2)).weights, [2, -1], atol=1e-5)
    assert 0 < objective.evaluate(np.zeros(2), 0.5, 7).count < 50
    assert ColumnObjective(df.limit(0), ["a", "b"], "t", LeastSquaresLoss()).evaluate(np.zeros(2)).count == 0


@pytest.mark.parametrize("updater", [simple_step, constant_step, l1_step, l2_step])
def test_resumed_descent_equals_an_uncut_one(updater):
    fn, start = bowl(np.array([1.0, -2.0]), np.array([1.0, 3.0])), np.array([4.0, 4.0])
    whole = minimize_gd(Local(fn), start, updater, 0.1, 6, 0.01, tol=0.0)
    seen = []
    minimize_gd(Local(fn), start, updater, 0.1, 3, 0.01, tol=0.0, on_iteration=lambda *now: seen.append(now))
    rest = Local(fn)
    fit = minimize_gd(rest, seen[-1][2], updater, 0.1, 3, 0.01, tol=0.0, first_iteration=seen[-1][0] + 1)
    np.testing.assert_allclose(fit.weights, whole.weights)
    np.testing.assert_allclose([s[1] for s in seen] + fit.history, whole.history)
    assert [seed for _, seed in rest.calls] == [46, 47, 48]
    with pytest.raises(ValueError, match="first_iteration"):
        minimize_gd(Local(fn), start, first_iteration=0)


def test_lbfgs_reports_every_iteration():
    seen = []
    fit = minimize_lbfgs(Local(rosenbrock), np.array([-1.2, 1.0]), on_iteration=lambda *now: seen.append(now))
    assert [s[0] for s in seen] == list(range(1, len(fit.history)))
    assert [s[1] for s in seen] == fit.history[1:]
    np.testing.assert_array_equal(seen[-1][2], fit.weights)
    assert seen[0][2] is not fit.weights
