"""Network training over a table: pack rows into blocks, hold them, run an optimiser."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandnet.functions import uniform_column
from bandnet.operators.blocks import block_measures, check_labels, measured_blocks, stack_blocks, staged_blocks
from bandnet.operators.losses import Loss, NetworkLoss, ScaledLoss
from bandnet.operators.objective import BlockObjective, with_weight_coordinates
from bandnet.operators.optimizers import SMALLEST_TOL, Fit, GradientDescent, Lbfgs, Optimizer, Progress
from bandnet.operators.restart import StateFolder
from bandnet.operators.topology import Topology
from bandnet.operators.updaters import Updater, constant_step

SOLVERS = ("l-bfgs", "gd")
DEFAULT_SEED = zlib.crc32(b"bandnet")


def fit_network(
    df: DataFrame,
    topology: Topology,
    features: str = "features",
    label: str = "label",
    block_size: int = 128,
    solver: str | Optimizer = "l-bfgs",
    max_iter: int = 100,
    tol: float = SMALLEST_TOL,
    step_size: float = 0.03,
    fraction: float = 1.0,
    reg: float = 0.0,
    corrections: int = 10,
    seed: int = DEFAULT_SEED,
    initial_weights: Sequence[float] | None = None,
    averaging: str = "rows",
    updater: Updater = constant_step,
    loss: Loss | None = None,
    partitions: int | None = None,
    durable: bool = False,
    target: str = "target",
    first_iteration: int = 1,
    on_iteration: Progress | None = None,
    key: str | None = None,
    sparse: bool = False,
    restart: str | None = None,
    part: str | None = None,
    scaling: str | None = None,
) -> Fit:
    """Train a network and return its weights and loss history.

    A topology whose target is a column learns the vectors of column ``target``. Given ``initial_weights`` win over
    ``seed``. ``loss`` replaces the network's own objective: how many weights there are and which labels are sound is then
    for the loss to say, and where its weights are not as many as the network's they start at zero.
    ``averaging="rows"`` weighs every row alike whatever the block boundaries; ``"blocks"``
    weighs every block alike, so a short last block counts as much as a full one.
    ``on_iteration`` is told of every iteration (see ``minimize_gd``, whose ``first_iteration`` resumes a run).
    ``partitions`` reshuffles the rows first: use it where a small file would leave cores idle.

    ``solver`` may be an ``Optimizer`` of any kind: it gets the objective and the start and brings its own settings, so
    those of the named solvers do not apply. With ``key`` minibatches are the same on every layout of the table. With
    ``sparse`` blocks hold only the entries of the features. ``restart`` is a folder that outlives the driver: L-BFGS
    keeps its state there after every iteration, and a run that finds one goes on from it to the bit.

    The source is read once: labels are checked and bounds are found while rows are packed. ``part`` names a boolean
    column, true for the rows to train on. ``scaling`` maps the features to [0, 1] inside the kernel, by the bounds of
    "all" rows or of those trained on ("train"); ``Fit.bounds`` has them.
    """
    if isinstance(solver, str) and solver not in SOLVERS:
        raise ValueError(f"solver must be one of {', '.join(SOLVERS)} or an optimizer, not {solver!r}")
    if not isinstance(solver, str) and not hasattr(solver, "optimize"):
        raise ValueError(f"an optimizer needs optimize(objective, initial), which {solver!r} lacks")
    if restart is not None and solver != "l-bfgs":
        raise ValueError("restart is for l-bfgs; other solvers start again from given weights")
    if block_size <= 0:
        raise ValueError("block_size must be positive")
    own = loss is None
    loss = NetworkLoss(topology) if own else loss
    count = loss.weight_count(topology.inputs)
    if initial_weights is not None and count == topology.weight_count:
        start = topology.check(initial_weights)
    elif initial_weights is not None:
        start = np.array(initial_weights, dtype=np.float64)
        if start.shape != (count,):
            raise ValueError(f"expected {count} weights but got {start.size}")
    else:
        start = topology.random_weights(seed) if count == topology.weight_count else np.zeros(count)
    label_col = label if loss.with_label else None
    target_col = target if getattr(loss, "with_target", False) else None
    if sparse and (part is not None or scaling is not None):
        raise ValueError("scaling makes rows dense: it and part are for dense blocks")
    rows = df.select(*dict.fromkeys(c for c in (features, label_col, target_col, key, part) if c))
    if partitions:
        rows = rows.repartition(partitions)
    classes = topology.outputs if own and label_col else None
    if sparse:
        if classes:
            check_labels(rows, label, classes)
        blocks = stack_blocks(rows, topology.inputs, block_size, features, label_col, target_col, topology.outputs, True, key)
    else:
        blocks = measured_blocks(
            rows, topology.inputs, block_size, features, label_col, classes, part, scaling, target_col, topology.outputs, key
        )
    bounds = None
    with staged_blocks(blocks, durable) as held:
        if not sparse:
            if classes or scaling:
                low, high, bad, example = block_measures(held)
                if bad:
                    raise ValueError(f"{bad} rows have a label outside 0..{classes - 1}, for example {example}")
                if scaling and np.isfinite(low).all() and len(low):
                    bounds = low, high
                    loss = ScaledLoss(loss, low, high)
            held = held.where("n > 0").drop("low", "high", "bad", "example")
        objective = BlockObjective(held, loss, topology.inputs, averaging)
        fit = _optimise(
            objective, start, solver, updater, step_size, max_iter, reg, fraction, tol, corrections, first_iteration, on_iteration,
            StateFolder(df.sparkSession, restart) if restart is not None else None,
        )
    fit.bounds = bounds
    return fit


def _optimise(
    objective, start, solver, updater, step_size, max_iter, reg, fraction, tol, corrections, first_iteration, on_iteration, states
) -> Fit:
    """Run the named solver with the trainer's settings, or the caller's own with its own."""
    if not isinstance(solver, str):
        return solver.optimize(objective, start)
    if solver == "gd":
        chosen = GradientDescent(
            updater, step_size, max_iter, reg, fraction, min(tol, 1.0), first_iteration=first_iteration, on_iteration=on_iteration
        )
    else:
        chosen = Lbfgs(
            updater, corrections, tol, max_iter, reg, on_iteration=on_iteration,
            resume=states.latest() if states else None, on_state=states.save if states else None,
        )
    return chosen.optimize(objective, start)


def random_weight_frame(spark: SparkSession, topology: Topology, seed: int) -> DataFrame:
    """``Topology.random_weights`` as a table ``(layer, input, output, value)`` that Spark makes itself, however many there are."""
    rows = with_weight_coordinates(spark.range(topology.weight_count), topology, "id")
    inputs = F.array(*[F.lit(float(n)) for _, n, _ in topology.weight_coordinates()])
    value = (uniform_column(F.col("id"), seed) * 4.8 - 2.4) / F.sqrt(F.get(inputs, F.col("layer")))
    return rows.select("layer", "input", "output", value.alias("value"))


def weight_frame(spark: SparkSession, topology: Topology, weights: Sequence[float]) -> DataFrame:
    """Weights as a table ``(layer, input, output, value)``; a bias has input -1."""
    flat = topology.check(weights)
    rows = []
    for number, (start, inputs, outputs) in enumerate(topology.weight_coordinates()):
        for at in range(inputs * outputs + outputs):
            source = at // outputs if at < inputs * outputs else -1
            rows.append((number, source, at % outputs, float(flat[start + at])))
    return spark.createDataFrame(rows, "layer int, input int, output int, value double")


def history_frame(spark: SparkSession, history: Sequence[float]) -> DataFrame:
    """The loss history as a table ``(iteration, loss)``, from iteration 0."""
    rows = [(i, float(v)) for i, v in enumerate(history)]
    return spark.createDataFrame(rows, "iteration long, loss double")


def formula_weights(count: int) -> np.ndarray:
    """Repeatable weights in [-0.5, 0.5) computed from the position alone, for tests and checks."""
    return ((np.arange(count, dtype=np.int64) * 7919 + 13) % 1000) / 1000.0 - 0.5
