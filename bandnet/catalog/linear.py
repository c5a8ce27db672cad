"""Queries for linear losses, gradient descent and L-BFGS on line items."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import functions as F

from bandnet.catalog import sql as S
from bandnet.catalog.registry import query
from bandnet.catalog.tables import LINE_ROWS_SQL, LINEAR_FEATURES, line_rows, rounded
from bandnet.functions.counter import sample_limit
from bandnet.operators import (
    BlockObjective,
    ColumnObjective,
    Fit,
    HingeLoss,
    Lbfgs,
    LeastSquaresLoss,
    LogisticLoss,
    MultinomialLoss,
    StateFolder,
    Topology,
    constant_step,
    fit_network,
    l1_step,
    l2_step,
    linear_sums,
    minimize_gd,
    minimize_lbfgs,
    simple_step,
    stack_blocks,
)
from bandnet.sources import scratch_path

# Points at which the gradients are checked
POINT = [0.25, -0.5, 0.75, -0.125]
CLASS_POINT = [0.25, -0.5, 0.75, -0.125, -0.375, 0.5, 0.125, 0.25]


def _margin(point, alias=""):
    return "(" + " + ".join(f"{w}::double * {alias}{x}" for w, x in zip(point, LINEAR_FEATURES)) + ")"


def _sums(loss: str, slopes: list[str], source: str) -> str:
    """One row of the mean loss and mean gradient."""
    cells = [f"{S.r(f'sum({loss}) / count(*)', 9)} AS loss"]
    cells += [
        f"{S.r(f'sum({slope} * {x}) / count(*)', 9)} AS g{k * 4 + i}"
        for k, slope in enumerate(slopes)
        for i, x in enumerate(LINEAR_FEATURES)
    ]
    return f"SELECT count(*) AS n, {', '.join(cells)} FROM {source}"


_M = f"m AS MATERIALIZED (SELECT *, {_margin(POINT)} AS m FROM rows)"
_K = (
    f"m AS MATERIALIZED (SELECT *, {_margin(CLASS_POINT[:4])} AS m1, {_margin(CLASS_POINT[4:])} AS m2 FROM rows), "
    "k AS MATERIALIZED (SELECT *, ln(1 + exp(m1) + exp(m2)) AS total FROM m)"
)

# name, loss, label column, point, SQL
LINEAR_CASES = [
    (
        "logistic",
        LogisticLoss(),
        "flag",
        POINT,
        S.with_([LINE_ROWS_SQL, _M], _sums("ln(1 + exp(-m)) + (1 - flag) * m", ["(1 / (1 + exp(-m)) - flag)"], "m")),
    ),
    (
        "multinomial",
        MultinomialLoss(3),
        "class",
        CLASS_POINT,
        S.with_(
            [LINE_ROWS_SQL, _K],
            _sums(
                "total - CASE class WHEN 1 THEN m1 WHEN 2 THEN m2 ELSE 0 END",
                [f"(exp(m{c} - total) - CASE WHEN class = {c} THEN 1 ELSE 0 END)" for c in (1, 2)],
                "k",
            ),
        ),
    ),
    (
        "least_squares",
        LeastSquaresLoss(),
        "target",
        POINT,
        S.with_([LINE_ROWS_SQL, _M], _sums("(m - target) * (m - target) / 2", ["(m - target)"], "m")),
    ),
    (
        "hinge",
        HingeLoss(),
        "flag",
        POINT,
        S.with_(
            [LINE_ROWS_SQL, _M],
            _sums(
                "greatest(1 - (2 * flag - 1) * m, 0)",
                ["(CASE WHEN 1 > (2 * flag - 1) * m THEN 1 - 2 * flag ELSE 0 END)"],
                "m",
            ),
        ),
    ),
]


def _column_gradient(loss, label, point):
    def run(spark, folder):
        rows = line_rows(spark, folder).select(*LINEAR_FEATURES, F.col(label).alias("y"))
        found = linear_sums(rows, 4, loss, point)
        names = ["loss", *[f"g{i}" for i in range(len(point))]]
        return found.select("n", *[rounded(F.col(c) / F.col("n"), 9).alias(c) for c in names])

    return run


def _kernel_gradient(loss, label, point):
    def run(spark, folder):
        rows = line_rows(spark, folder).select(F.array(*LINEAR_FEATURES).alias("features"), label)
        blocks = stack_blocks(rows, 4, block_size=256, label=label)
        # one evaluation reads the blocks once, so they are not kept
        found = BlockObjective(blocks, loss, 4).evaluate(np.array(point))
        # one row of nine numbers at most
        values = [round(v, 9) + 0.0 for v in (found.loss, *map(float, found.gradient))]
        names = ["loss", *[f"g{i}" for i in range(len(point))]]
        return spark.createDataFrame([(found.count, *values)], "n long, " + ", ".join(f"{c} double" for c in names))

    return run


for _name, _loss, _label, _point, _sql in LINEAR_CASES:
    query(f"{_name}_gradient", _sql)(_column_gradient(_loss, _label, _point))
    query(f"{_name}_gradient_blocks", _sql)(_kernel_gradient(_loss, _label, _point))


STEPS, STEP, REG = 3, 0.5, 0.1


def _update(kind: str, i: int, iteration: int) -> str:
    """The SQL of one weight after a step."""
    size = STEP if kind == "constant" else f"({STEP}::double / sqrt({iteration}))"
    moved = f"(w.w{i} - {size} * g.g{i})"
    if kind == "l1":
        return f"sign({moved}) * greatest(0.0, abs({moved}) - {REG}::double * {size})"
    if kind == "l2":
        return f"((1 - {size} * {REG}::double) * w.w{i} - {size} * g.g{i})"
    return moved


def _penalty(kind: str, w: str = "w") -> str:
    if kind == "l1":
        return f"{REG}::double * (" + " + ".join(f"abs({w}.w{i})" for i in range(4)) + ")"
    if kind == "l2":
        return f"0.5 * {REG}::double * (" + " + ".join(f"{w}.w{i} * {w}.w{i}" for i in range(4)) + ")"
    return "0.0"


def _gd_sql(kind: str) -> str:
    """Unrolled least-squares descent: final weights and the loss recorded at each step."""
    ctes = [LINE_ROWS_SQL, "s1 AS (SELECT " + ", ".join(f"{p}::double AS w{i}" for i, p in enumerate(POINT)) + ")"]
    for t in range(1, STEPS + 1):
        margin = " + ".join(f"w.w{i} * x{i}" for i in range(4))
        ctes.append(f"r{t} AS MATERIALIZED (SELECT rows.*, {margin} - target AS diff FROM rows, s{t} w)")
        sums = ", ".join(f"sum(diff * x{i}) / count(*) AS g{i}" for i in range(4))
        ctes.append(f"g{t} AS MATERIALIZED (SELECT sum(diff * diff / 2) / count(*) AS loss, {sums} FROM r{t})")
        ctes.append(
            f"s{t + 1} AS MATERIALIZED (SELECT " + ", ".join(f"{_update(kind, i, t)} AS w{i}" for i in range(4))
            + f" FROM s{t} w, g{t} g)"
        )
    last = f"s{STEPS + 1}"
    rows = [f"SELECT 'w{i}' AS name, {S.r(f'w{i}', 9)} AS value FROM {last}" for i in range(4)]
    rows += [
        f"SELECT 'loss{t}' AS name, {S.r(f'g.loss + {_penalty(kind)}', 9)} AS value FROM g{t} g, s{t} w"
        for t in range(1, STEPS + 1)
    ]
    return S.with_(ctes, "\nUNION ALL ".join(rows))


UPDATERS = {"simple": simple_step, "l1": l1_step, "l2": l2_step, "constant": constant_step}


def named_values(spark, weights, losses=(), digits=9, first=1):
    """Weights and losses as ``(name, value)`` rows."""
    rows = [(f"w{i}", round(float(v), digits) + 0.0) for i, v in enumerate(weights)]
    rows += [(f"loss{t}", round(float(v), digits) + 0.0) for t, v in enumerate(losses, first)]
    return spark.createDataFrame(rows, "name string, value double")


def _held_objective(spark, folder, label="target", loss=None):
    """A column objective over cached rows, and the rows to release."""
    rows = line_rows(spark, folder).select(*LINEAR_FEATURES, label).persist()
    return ColumnObjective(rows, LINEAR_FEATURES, label, loss or LeastSquaresLoss()), rows


def _descent(updater):
    def run(spark, folder):
        objective, rows = _held_objective(spark, folder)
        try:
            fit = minimize_gd(objective, np.array(POINT), updater, STEP, STEPS, REG, tol=0.0)
        finally:
            rows.unpersist()
        return named_values(spark, fit.weights, fit.history)

    return run


@query("gd_resumed", _gd_sql("l2"))
def _gd_resumed(spark, folder):
    """The steps of ``gd_steps_l2`` in two runs, the second from what the first one's last iteration reported."""
    objective, rows = _held_objective(spark, folder)
    seen = []
    try:
        half = STEPS // 2
        minimize_gd(objective, np.array(POINT), l2_step, STEP, half, REG, tol=0.0, on_iteration=lambda *now: seen.append(now))
        at, _, weights = seen[-1]
        fit = minimize_gd(objective, weights, l2_step, STEP, STEPS - half, REG, tol=0.0, first_iteration=at + 1)
    finally:
        rows.unpersist()
    return named_values(spark, fit.weights, [loss for _, loss, _ in seen] + fit.history)


for _kind, _updater in UPDATERS.items():
    query(f"gd_steps_{_kind}", _gd_sql(_kind))(_descent(_updater))


MOMENTUM = 0.75
#: Rows in a minibatch
SHARE = 0.05


@dataclass(frozen=True)
class HeavyBall:
    """An optimizer that no solver name stands for: descent whose steps keep a share of the step before."""

    step: float
    momentum: float
    iterations: int

    def optimize(self, objective, initial):
        w, before, history = np.array(initial, dtype=float), np.zeros(len(initial)), []
        for _ in range(self.iterations):
            found = objective.evaluate(w)
            history.append(found.loss)
            before = self.momentum * before - self.step * found.gradient
            w = w + before
        return Fit(w, history, self.iterations)


def _momentum_sql() -> str:
    start = ", ".join([f"{p}::double AS w{i}" for i, p in enumerate(POINT)] + [f"0::double AS v{i}" for i in range(4)])
    ctes = [LINE_ROWS_SQL, f"s1 AS (SELECT {start})"]
    margin = " + ".join(f"w.w{i} * x{i}" for i in range(4))
    for t in range(1, STEPS + 1):
        ctes.append(f"r{t} AS MATERIALIZED (SELECT rows.*, {margin} - target AS diff FROM rows, s{t} w)")
        sums = ", ".join(f"sum(diff * x{i}) / count(*) AS g{i}" for i in range(4))
        ctes.append(f"g{t} AS MATERIALIZED (SELECT sum(diff * diff / 2) / count(*) AS loss, {sums} FROM r{t})")
        speed = [f"{MOMENTUM}::double * w.v{i} - {STEP}::double * g.g{i}" for i in range(4)]
        moved = ", ".join([f"w.w{i} + {v} AS w{i}" for i, v in enumerate(speed)] + [f"{v} AS v{i}" for i, v in enumerate(speed)])
        ctes.append(f"s{t + 1} AS MATERIALIZED (SELECT {moved} FROM s{t} w, g{t} g)")
    rows = [f"SELECT 'w{i}' AS name, {S.r(f'w{i}', 9)} AS value FROM s{STEPS + 1}" for i in range(4)]
    rows += [f"SELECT 'loss{t}' AS name, {S.r('loss', 9)} AS value FROM g{t}" for t in range(1, STEPS + 1)]
    return S.with_(ctes, "\nUNION ALL ".join(rows))


@query("gd_heavy_ball", _momentum_sql())
def _gd_heavy_ball(spark, folder):
    """The trainer with an optimizer and a loss of the caller's own."""
    rows = line_rows(spark, folder).select(F.array(*LINEAR_FEATURES).alias("features"), "target")
    fit = fit_network(
        rows, Topology.regressor([4, 1]), label="target", loss=LeastSquaresLoss(), block_size=256,
        solver=HeavyBall(STEP, MOMENTUM, STEPS), initial_weights=POINT,
    )
    return named_values(spark, fit.weights, fit.history)


def _minibatch_sql() -> str:
    """Unrolled steps over columns, each on the rows that the sample of its seed draws."""
    key = "l_orderkey::varchar || '-' || l_linenumber::varchar"
    counted = LINE_ROWS_SQL.removesuffix(" FROM lineitem)") + f", {S.row_counter(f'({key})')} AS c FROM lineitem)"
    fields = "x0, x1, x2, x3, target"
    ctes = [counted, "s1 AS (SELECT " + ", ".join(f"{p}::double AS w{i}" for i, p in enumerate(POINT)) + ")"]
    margin = " + ".join(f"w.w{i} * x{i}" for i in range(4))
    for t in range(1, STEPS + 1):
        drawn = S.permuted("c", 42 + t, "rows", fields)
        ctes.append(f"k{t} AS MATERIALIZED (SELECT {fields} FROM ({drawn}) WHERE p < {sample_limit(SHARE)})")
        ctes.append(f"r{t} AS MATERIALIZED (SELECT k{t}.*, {margin} - target AS diff FROM k{t}, s{t} w)")
        sums = ", ".join(f"sum(diff * x{i}) / count(*) AS g{i}" for i in range(4))
        ctes.append(f"g{t} AS MATERIALIZED (SELECT sum(diff * diff / 2) / count(*) AS loss, {sums} FROM r{t})")
        moved = ", ".join(f"{_update('simple', i, t)} AS w{i}" for i in range(4))
        ctes.append(f"s{t + 1} AS MATERIALIZED (SELECT {moved} FROM s{t} w, g{t} g)")
    rows = [f"SELECT 'w{i}' AS name, {S.r(f'w{i}', 9)} AS value FROM s{STEPS + 1}" for i in range(4)]
    rows += [f"SELECT 'loss{t}' AS name, {S.r('loss', 9)} AS value FROM g{t}" for t in range(1, STEPS + 1)]
    return S.with_(ctes, "\nUNION ALL ".join(rows))


@query("gd_minibatch_columns", _minibatch_sql())
def _gd_minibatch_columns(spark, folder):
    key = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    rows = line_rows(spark, folder, key.alias("line")).select(*LINEAR_FEATURES, "target", "line").persist()
    try:
        objective = ColumnObjective(rows, LINEAR_FEATURES, "target", LeastSquaresLoss(), key="line")
        fit = minimize_gd(objective, np.array(POINT), simple_step, STEP, STEPS, fraction=SHARE, tol=0.0)
    finally:
        rows.unpersist()
    return named_values(spark, fit.weights, fit.history)


def _normal_sql(reg: float) -> str:
    cells = [
        f"sum(x{i} * x{j}) / count(*)" + (f" + {reg}::double" if i == j and reg else "") + f" AS a{i}{j}"
        for i in range(4)
        for j in range(4)
    ]
    cells += [f"sum(x{i} * target) / count(*) AS b{i}" for i in range(4)]
    ctes = [LINE_ROWS_SQL, f"normal AS MATERIALIZED (SELECT {', '.join(cells)} FROM rows)", *S.eliminate_ctes("normal", 4)]
    return S.with_(ctes, "\nUNION ALL ".join(f"SELECT 'w{i}' AS name, {S.r(f'w{i}', 5)} AS value FROM solved" for i in range(4)))


def _lbfgs(updater, reg):
    def run(spark, folder):
        objective, rows = _held_objective(spark, folder)
        try:
            fit = minimize_lbfgs(objective, np.zeros(4), updater, tol=1e-12, iterations=50, reg=reg)
        finally:
            rows.unpersist()
        return named_values(spark, fit.weights, digits=5)

    return run


query("lbfgs_least_squares", _normal_sql(0.0))(_lbfgs(constant_step, 0.0))
query("lbfgs_ridge", _normal_sql(REG))(_lbfgs(l2_step, REG))


@query("lbfgs_restarted", _normal_sql(REG))
def _lbfgs_restarted(spark, folder):
    """Ridge regression cut after every second iteration; each run goes on from the table that the one before left."""
    objective, rows = _held_objective(spark, folder)
    states = StateFolder(spark, scratch_path(spark, "restart"), every=2)
    try:
        done, fit = 0, None
        while done < 50:
            done += 2
            solver = Lbfgs(l2_step, tol=1e-12, iterations=done, reg=REG, resume=states.latest(), on_state=states.save)
            fit = solver.optimize(objective, np.zeros(4))
            if fit.reason != "iterations":
                break
    finally:
        rows.unpersist()
        states.clear()
    return named_values(spark, fit.weights, digits=5)


@query("trainer_least_squares", _normal_sql(0.0))
def _trainer_least_squares(spark, folder):
    """The same fit through the trainer, whose loss is swapped for one of a real-valued label."""
    rows = line_rows(spark, folder).select(F.array(*LINEAR_FEATURES).alias("features"), "target")
    fit = fit_network(
        rows, Topology.regressor([4, 1]), label="target", loss=LeastSquaresLoss(), block_size=256, tol=1e-12, max_iter=50
    )
    return named_values(spark, fit.weights, digits=5)


def _newton_sql(rounds: int = 6) -> str:
    """The logistic optimum by unrolled Newton steps."""
    ctes = [LINE_ROWS_SQL, "solved_0 AS (SELECT " + ", ".join(f"0::double AS w{i}" for i in range(4)) + ")"]
    for t in range(1, rounds + 1):
        margin = " + ".join(f"w.w{i} * x{i}" for i in range(4))
        ctes.append(
            f"p{t} AS MATERIALIZED (SELECT x0, x1, x2, x3, flag, {margin} AS m, 1 / (1 + exp(-({margin}))) AS p FROM rows, solved_{t - 1} w)"
        )
        # curvature times new weights = curvature times old weights minus slope
        cells = [f"sum(p * (1 - p) * x{i} * x{j}) / count(*) AS a{i}{j}" for i in range(4) for j in range(4)]
        cells += [f"sum((p * (1 - p) * m - p + flag) * x{i}) / count(*) AS b{i}" for i in range(4)]
        ctes.append(f"newton{t} AS MATERIALIZED (SELECT {', '.join(cells)} FROM p{t})")
        ctes += S.eliminate_ctes(f"newton{t}", 4, f"_{t}")
    last = f"solved_{rounds}"
    return S.with_(ctes, "\nUNION ALL ".join(f"SELECT 'w{i}' AS name, {S.r(f'w{i}', 5)} AS value FROM {last}" for i in range(4)))


@query("lbfgs_logistic", _newton_sql())
def _lbfgs_logistic(spark, folder):
    objective, rows = _held_objective(spark, folder, "flag", LogisticLoss())
    try:
        fit = minimize_lbfgs(objective, np.zeros(4), tol=1e-12, iterations=60)
    finally:
        rows.unpersist()
    return named_values(spark, fit.weights, digits=5)
