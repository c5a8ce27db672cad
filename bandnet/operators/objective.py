"""The distributed objective: one Spark job per evaluation of loss and gradient.

Every partition adds up its own rows, so one model-sized row leaves each partition. Those rows
are merged in a tree of bounded fan-in, and only the last few reach the driver: neither a task
nor the driver ever holds a number of partial results that grows with the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandnet.functions import row_counter, sampled_array, sampled_column
from bandnet.operators.arrow import lists_from_matrix, matrix_from_lists, small_batches
from bandnet.operators.blocks import block_arrays, block_counters, labeled_rows, pack_rows, stack_blocks
from bandnet.operators.losses import LinearLoss, Loss, NetworkLoss
from bandnet.operators.sparse import SparseRows, pack_sparse, sparse_entries
from bandnet.operators.topology import Topology

PARTIAL_SCHEMA = "part int, rows long, blocks long, loss double, gradient array<double>"
FAN_IN = 32
CHUNK_ROWS = 2048


@dataclass(frozen=True)
class Evaluation:
    """Mean loss and gradient over ``count`` units (rows, or blocks when averaging by block)."""

    loss: float
    gradient: np.ndarray
    count: int


def _partial_batch(part: int, rows: int, blocks: int, loss: float, gradient: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([part], pa.int32()),
            pa.array([rows], pa.int64()),
            pa.array([blocks], pa.int64()),
            pa.array([loss], pa.float64()),
            lists_from_matrix(gradient[None, :]),
        ],
        names=["part", "rows", "blocks", "loss", "gradient"],
    )


def _partition_sum(
    loss: Loss, width: int, by_block: bool, weights: Callable[[], np.ndarray], sample: tuple[float, int] | None = None
):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights()
        total, gradient, rows, blocks = 0.0, np.zeros(getattr(loss, "gradient_size", len(w))), 0, 0
        for batch in batches:
            x, y, counts = block_arrays(batch, width)
            if sample is not None:
                keep = sampled_array(block_counters(batch), *sample)
                x, y = x.where(keep) if isinstance(x, SparseRows) else x[keep], y[keep] if len(y) else y
            # chunks follow the blocks when a block counts as one unit; otherwise any cut does
            cuts = np.append(0, np.cumsum(counts)) if by_block else np.append(np.arange(0, len(x), CHUNK_ROWS), len(x))
            for start, stop in zip(cuts[:-1], cuts[1:]):
                rows_here = x[start:stop]
                if not isinstance(rows_here, SparseRows):
                    rows_here = np.asarray(rows_here, dtype=np.float64)
                part_loss, part_gradient = loss.partial(rows_here, y[start:stop], w)
                unit = float(stop - start) if by_block else 1.0
                total += part_loss / unit
                gradient += part_gradient if unit == 1.0 else part_gradient / unit
            rows += len(x)
            blocks += len(counts)
        if rows:
            yield _partial_batch(TaskContext.get().partitionId(), rows, blocks, total, gradient)

    return run


def _merge(table: pa.Table) -> pa.Table:
    """Add the partial sums of one bucket, in partition order so that repeats agree to the bit."""
    table = table.sort_by("part")
    width = len(table.column("gradient")[0])
    gradient = matrix_from_lists(table.column("gradient"), width).sum(axis=0)
    return pa.Table.from_batches(
        [
            _partial_batch(
                table.column("part")[0].as_py() // FAN_IN,
                int(np.asarray(table.column("rows")).sum()),
                int(np.asarray(table.column("blocks")).sum()),
                float(np.asarray(table.column("loss")).sum()),
                gradient,
            )
        ]
    )


def merge_level(partials: DataFrame) -> DataFrame:
    """Merge the partial rows of ``FAN_IN`` neighbouring partitions into one."""
    return partials.groupBy(F.expr(f"part div {FAN_IN}").alias("bucket")).applyInArrow(_merge, PARTIAL_SCHEMA)


def merge_partials(partials: DataFrame, parts: int) -> DataFrame:
    """Merge partial rows level by level until at most ``FAN_IN`` are left."""
    while parts > FAN_IN:
        partials = merge_level(partials)
        parts = -(-parts // FAN_IN)
    return partials


class BlockObjective:
    """Loss and gradient over a table of blocks.

    Where blocks were packed with a key, a minibatch is made of the rows whose key's hash falls into the sample of its
    seed, the same on every layout of the table. Otherwise whole blocks are drawn, partition by partition.
    """

    def __init__(self, blocks: DataFrame, loss: Loss, width: int, averaging: str = "rows") -> None:
        if averaging not in ("rows", "blocks"):
            raise ValueError("averaging must be 'rows' or 'blocks'")
        self.blocks = blocks
        self.loss = loss
        self.width = width
        self.averaging = averaging
        self.report_scale = loss.report_scale
        self.weight_count = loss.weight_count(width)
        self.keyed = "counters" in blocks.columns
        if self.keyed and averaging == "blocks":
            raise ValueError("minibatches by key are made of rows: averaging must be 'rows'")
        self._parts = blocks.rdd.getNumPartitions()

    def evaluate(self, w: np.ndarray, fraction: float = 1.0, seed: int | None = None) -> Evaluation:
        """One job: broadcast the weights, sum by partition, merge, and take the mean."""
        spark = self.blocks.sparkSession
        shared = spark.sparkContext.broadcast(np.ascontiguousarray(w, dtype=np.float64))
        by_block = self.averaging == "blocks"
        try:
            by_row = self.keyed and fraction < 1.0
            blocks = self.blocks if fraction >= 1.0 or by_row else self.blocks.sample(False, fraction, seed)
            kernel = _partition_sum(self.loss, self.width, by_block, lambda: shared.value, (fraction, seed) if by_row else None)
            with small_batches(spark):
                found = merge_partials(blocks.mapInArrow(kernel, PARTIAL_SCHEMA), self._parts).toArrow().sort_by("part")
        finally:
            shared.destroy()
        if found.num_rows == 0:
            return Evaluation(0.0, np.zeros(self.weight_count), 0)
        count = int(np.asarray(found.column("blocks" if by_block else "rows")).sum())
        gradient = matrix_from_lists(found.column("gradient"), self.weight_count).sum(axis=0)
        return Evaluation(float(np.asarray(found.column("loss")).sum()) / count, gradient / count, count)


class ColumnObjective:
    """Loss and gradient of a linear loss over scalar columns: a plain aggregate, all in the JVM.

    With ``key`` the rows of a minibatch are those whose key's hash falls into the sample of its seed, the same on every
    layout of the table; without it they are drawn partition by partition.
    """

    def __init__(self, df: DataFrame, features: Sequence[str], label: str, loss: LinearLoss, key: str | None = None) -> None:
        self.features = list(features)
        self.loss = loss
        self.report_scale = 1.0
        self.weight_count = loss.weight_count(len(self.features))
        self.keyed = key is not None
        self.rows = df.select(
            *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(self.features)],
            F.col(label).cast("double").alias("y"),
            *([row_counter(key).alias("counter")] if self.keyed else []),
        )

    def aggregate(self, w: np.ndarray, rows: DataFrame | None = None) -> DataFrame:
        """One row ``(n, loss, g0, g1, …)`` of sums; lazy."""
        return linear_sums(self.rows if rows is None else rows, len(self.features), self.loss, w)

    def _blocks(self, rows: DataFrame) -> BlockObjective:
        """The same objective over arrays of the columns, packed for one pass."""
        names = [f"x{i}" for i in range(len(self.features))]
        sound = rows.dropna(subset=[*names, "y"]).select(F.array(*names).alias("features"), F.col("y").alias("label"))
        return BlockObjective(stack_blocks(sound, len(names), CHUNK_ROWS), self.loss, len(names))

    def evaluate(self, w: np.ndarray, fraction: float = 1.0, seed: int | None = None) -> Evaluation:
        rows = self.rows
        if fraction < 1.0:
            rows = rows.where(sampled_column(F.col("counter"), fraction, seed)) if self.keyed else rows.sample(False, fraction, seed)
        if self.weight_count > WIDE_SUMS:
            return self._blocks(rows).evaluate(w)
        found = self.aggregate(w, rows).first()
        n = int(found["n"])
        if n == 0:
            return Evaluation(0.0, np.zeros(self.weight_count), 0)
        sums = np.array([found[f"g{i}"] for i in range(self.weight_count)])
        return Evaluation(found["loss"] / n, sums / n, n)


#: More sums than this are matrix products of the kernel: so many columns are no plan any more
WIDE_SUMS = 48


def linear_sums(rows: DataFrame, width: int, loss: LinearLoss, w: Sequence[float]) -> DataFrame:
    """Row count, summed loss and summed gradient of a linear loss over columns ``x0…, y``.

    Rows with a null or NaN in any of them are left out of all three, as in ``gram_matrix``. The weights come from a
    table of one row and are no literals: the code that Spark generates is the same for all weights and compiled once.
    Beyond ``WIDE_SUMS`` sums the rows go through the kernel, whose plan does not grow with the columns.
    """
    names = [f"x{i}" for i in range(width)]
    rows = rows.dropna(subset=[*names, "y"])
    weights = np.asarray(w, dtype=float)
    sums = ["n", "loss", *[f"g{i}" for i in range(len(weights))]]
    if len(weights) > WIDE_SUMS:
        return _wide_linear_sums(rows.select(F.array(*names).alias("features"), "y"), width, loss, weights, sums)
    xs = [F.col(name) for name in names]
    beside = rows.sparkSession.createDataFrame(pa.table({"w": pa.array([weights.tolist()])})).scalar()
    held = rows.select(*xs, "y", beside.alias("w"))

    def margin(k: int) -> Column:
        total = F.lit(0.0)
        for i, x in enumerate(xs):
            total = total + F.get("w", F.lit(k * width + i)) * x
        return total

    margins = held.select(*xs, "y", *[margin(k).alias(f"m{k}") for k in range(loss.margins)])
    value, slopes = loss.columns([F.col(f"m{k}") for k in range(loss.margins)], F.col("y"))
    sloped = margins.select(*xs, value.alias("loss"), *[s.alias(f"s{k}") for k, s in enumerate(slopes)])
    return sloped.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("loss").alias("loss"),
        *[
            F.sum(F.col(f"s{k}") * xs[i]).alias(f"g{k * width + i}")
            for k in range(loss.margins)
            for i in range(width)
        ],
    )


def _wide_linear_sums(rows: DataFrame, width: int, loss: LinearLoss, weights: np.ndarray, sums: list[str]) -> DataFrame:
    """``linear_sums`` of rows ``(features, y)`` as matrix products; a table without rows has null sums, as there."""
    pack, total = pack_rows(width, CHUNK_ROWS, True), _partition_sum(loss, width, False, lambda: weights)
    partials = merge_level(rows.mapInArrow(lambda batches: total(pack(batches)), PARTIAL_SCHEMA))
    cells = partials.select("rows", F.posexplode(F.concat(F.array("loss"), "gradient")).alias("at", "value"))
    by_cell = cells.groupBy("at").agg(F.sum("rows").alias("n"), F.sum("value").alias("total"))
    held = by_cell.agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "total"))).alias("cells"))
    return held.select(F.coalesce("n", F.lit(0).cast("long")).alias("n"), *[F.get("cells", F.lit(i))["total"].alias(c) for i, c in enumerate(sums[1:])])


def sparse_linear_sums(
    df: DataFrame, loss: LinearLoss, weights: Sequence[float], width: int, features: str = "features", label: str = "label"
) -> DataFrame:
    """Sums of a linear loss over sparse rows as a long table ``(position, total)``; lazy.

    Position -2 is the row count, -1 the loss, and ``k * width + i`` the gradient of margin ``k`` by feature ``i``; features
    without an entry in any row have no position. Work and shuffle follow the entries, not the width, and the table
    never passes through the driver.
    """
    w = np.asarray(weights, dtype=np.float64)
    if w.shape != (loss.weight_count(width),):
        raise ValueError(f"expected {loss.weight_count(width)} weights but got {w.size}")
    matrix = np.ascontiguousarray(w.reshape(loss.margins, width).T)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pack_sparse(width, CHUNK_ROWS, True)(batches):
            x, y, _ = block_arrays(batch, width)
            value, slopes = loss.values(x @ matrix, y)
            used, at = np.unique(x.positions, return_inverse=True)
            row = x.row
            sums = [np.bincount(at, weights=x.values * slopes[row, k], minlength=len(used)) for k in range(loss.margins)]
            positions = np.concatenate([[-2, -1], *[used.astype(np.int64) + k * width for k in range(loss.margins)]])
            totals = np.concatenate([[float(len(x)), float(value.sum())], *sums])
            yield pa.RecordBatch.from_arrays([pa.array(positions, pa.int64()), pa.array(totals, pa.float64())], names=["position", "total"])

    rows = labeled_rows(df, None, label, values=sparse_entries(df, features))
    return rows.mapInArrow(run, "position long, total double").groupBy("position").agg(F.sum("total").alias("total"))


class _ForwardLoss:
    """A network's loss without a gradient, for the kernel."""

    gradient_size = 0

    def __init__(self, loss: NetworkLoss) -> None:
        self.loss = loss

    def partial(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
        return self.loss.value(x, y, w), np.empty(0)


def partial_sums(
    df: DataFrame,
    topology: Topology,
    weights: Sequence[float],
    features: str = "features",
    label: str = "label",
    averaging: str = "rows",
    block_size: int = 128,
    target: str = "target",
    forward_only: bool = False,
) -> DataFrame:
    """Partial losses and gradients of a network straight from rows, one per partition; lazy.

    Rows are packed and summed in one pass through Python, for a single evaluation that needs no
    blocks kept. With ``forward_only`` nothing is propagated back and the gradients are empty.
    """
    w = topology.check(weights)
    label_col = label if topology.target == "label" else None
    target_col, target_width = (target, topology.outputs) if topology.target == "column" else (None, 0)
    rows = labeled_rows(df, features, label_col, topology.inputs, target_col, target_width)
    pack = pack_rows(topology.inputs, block_size, label_col is not None, target_width)
    loss = _ForwardLoss(NetworkLoss(topology)) if forward_only else NetworkLoss(topology)
    total = _partition_sum(loss, topology.inputs, averaging == "blocks", lambda: w)
    return rows.mapInArrow(lambda batches: total(pack(batches)), PARTIAL_SCHEMA)


def gradient_frame(df: DataFrame, topology: Topology, weights: Sequence[float], averaging: str = "rows", **options) -> DataFrame:
    """The mean gradient of a network as a lazy table ``(layer, input, output, gradient)``.

    The bias of an output has input -1. Partial gradients are merged ``FAN_IN`` at a time and then
    added by weight position in a shuffle, so the table never passes through the driver.
    """
    partials = merge_level(partial_sums(df, topology, weights, averaging=averaging, **options))
    summed = (
        partials.select(F.col(averaging).alias("units"), F.posexplode("gradient").alias("position", "value"))
        .groupBy("position")
        .agg((F.sum("value") / F.sum("units")).alias("gradient"))
    )
    return with_weight_coordinates(summed, topology, "position").select("layer", "input", "output", "gradient")


def loss_frame(df: DataFrame, topology: Topology, weights: Sequence[float], averaging: str = "rows", **options) -> DataFrame:
    """The reported mean loss of a network as a one-row table ``(loss, units)``; lazy."""
    partials = partial_sums(df, topology, weights, averaging=averaging, forward_only=True, **options)
    units = F.sum(averaging)
    return partials.agg((F.sum("loss") / units * topology.report_scale).alias("loss"), units.alias("units"))


def with_weight_coordinates(df: DataFrame, topology: Topology, position: str) -> DataFrame:
    """Add ``layer``, ``input`` (-1 for a bias) and ``output`` for a flat weight position."""
    layer = row = out = None
    for number, (start, inputs, outputs) in reversed(list(enumerate(topology.weight_coordinates()))):
        at = F.col(position) - start
        bias = at >= inputs * outputs
        this_row = F.when(bias, F.lit(-1)).otherwise(F.floor(at / outputs).cast("int"))
        this_out = (at % outputs).cast("int")
        if layer is None:
            layer, row, out = F.lit(number), this_row, this_out
        else:
            end = start + inputs * outputs + outputs
            here = F.col(position) < end
            layer = F.when(here, F.lit(number)).otherwise(layer)
            row = F.when(here, this_row).otherwise(row)
            out = F.when(here, this_out).otherwise(out)
    return df.withColumns({"layer": layer, "input": row, "output": out})
