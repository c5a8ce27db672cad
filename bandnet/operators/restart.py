"""States of an optimiser as tables in the shared folder, so that training can go on after its driver is lost."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandnet.operators.optimizers import LbfgsState

STATE_SCHEMA = "kind string, number int, values array<double>"


def state_frame(spark: SparkSession, state: LbfgsState) -> DataFrame:
    """A state as rows ``(kind, number, values)``: a vector each for the weights, the gradient, the history and every pair."""
    rows = [("weights", 0, state.weights), ("gradient", 0, state.gradient), ("history", 0, np.array(state.history))]
    rows += [("scalars", 0, np.array([state.loss, float(state.evaluations)]))]
    for number, (step, change) in enumerate(state.pairs):
        rows += [("step", number, step), ("change", number, change)]
    kinds, numbers, values = zip(*rows, strict=True)
    made = pa.table({"kind": pa.array(kinds), "number": pa.array(numbers, pa.int32()), "values": pa.array([v.tolist() for v in values])})
    return spark.createDataFrame(made, STATE_SCHEMA)


def state_from_frame(frame: DataFrame) -> LbfgsState:
    """The state that ``state_frame`` wrote."""
    held = {(r["kind"], r["number"]): np.array(r["values"], dtype=np.float64) for r in frame.collect()}
    loss, evaluations = held["scalars", 0].tolist()
    pairs = sorted(n for kind, n in held if kind == "step")
    return LbfgsState(
        held["weights", 0], held["gradient", 0], loss, held["history", 0].tolist(),
        [(held["step", n], held["change", n]) for n in pairs], int(evaluations),
    )


class StateFolder:
    """Keeps the states of a run below a path that outlives the driver, one table per saved iteration.

    ``save`` is meant for ``on_state``. A table counts only once Spark has marked it complete, so a run that is cut
    while writing goes on from the state before; older tables are deleted when a newer one is complete.
    """

    def __init__(self, spark: SparkSession, path: str, every: int = 1) -> None:
        if every < 1:
            raise ValueError("every must be at least 1")
        self.spark, self.path, self.every = spark, path.rstrip("/"), every

    def _files(self):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def iterations(self) -> list[int]:
        """The iterations whose state is complete, ascending."""
        where, files = self._files()
        if not files.exists(where):
            return []
        inside = [s.getPath() for s in files.listStatus(where)]
        mark = self.spark._jvm.org.apache.hadoop.fs.Path
        done = [p.getName() for p in inside if files.exists(mark(p, "_SUCCESS"))]
        return sorted(int(name.removeprefix("iteration-")) for name in done if name.startswith("iteration-"))

    def save(self, state: LbfgsState) -> None:
        if state.iteration % self.every:
            return
        state_frame(self.spark, state).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/iteration-{state.iteration}")
        _, files = self._files()
        for old in self.iterations()[:-1]:
            files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/iteration-{old}"), True)

    def latest(self) -> LbfgsState | None:
        """The newest complete state, or None."""
        found = self.iterations()
        if not found:
            return None
        return state_from_frame(self.spark.read.schema(STATE_SCHEMA).parquet(f"{self.path}/iteration-{found[-1]}"))

    def clear(self) -> None:
        """Delete the folder."""
        where, files = self._files()
        files.delete(where, True)
