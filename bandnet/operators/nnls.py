"""Non-negative least squares over tables.

The normal equations are sums over rows, so Spark aggregates them with partial sums in every
partition; what is left to solve is one small system per result row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandnet.functions import feature_array
from bandnet.operators.arrow import lists_from_matrix, matrix_from_lists


def _solve_passive(gram: np.ndarray, rhs: np.ndarray, passive: np.ndarray) -> np.ndarray:
    """Least squares on each row's passive unknowns; rows that share a set are solved together."""
    out = np.zeros_like(rhs)
    sets, member = np.unique(passive, axis=0, return_inverse=True)
    member = member.reshape(-1)
    for number, free in enumerate(sets):
        at = np.flatnonzero(free)
        if len(at):
            rows = np.flatnonzero(member == number)
            system = gram[np.ix_(at, at)]
            try:
                found = np.linalg.solve(system, rhs[np.ix_(rows, at)].T)
            except np.linalg.LinAlgError:
                found = np.linalg.lstsq(system, rhs[np.ix_(rows, at)].T, rcond=None)[0]
            out[np.ix_(rows, at)] = found.T
    return out


def solve_nonnegative(gram: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Minimise ``x'Gx/2 - b'x`` over ``x >= 0`` for every row ``b`` of ``rhs``, by active sets.

    Each round frees one unknown per unfinished row, then steps back until all of the row's
    free unknowns are positive. The objective falls in every round, so the search is finite.
    """
    rows, n = rhs.shape
    x = np.zeros((rows, n))
    passive = np.zeros((rows, n), dtype=bool)
    tol = 1e-12 * np.maximum(np.abs(rhs).max(axis=1, initial=0.0), 1e-300)
    open_rows = np.arange(rows)
    for _ in range(max(400, 20 * n)):
        slope = rhs[open_rows] - x[open_rows] @ gram
        slope[passive[open_rows]] = -np.inf
        gain = slope.max(axis=1, initial=-np.inf)
        going = gain > tol[open_rows]
        open_rows = open_rows[going]
        if not len(open_rows):
            break
        passive[open_rows, slope[going].argmax(axis=1)] = True
        todo = open_rows
        while len(todo):
            trial = _solve_passive(gram, rhs[todo], passive[todo])
            bad = passive[todo] & (trial <= 0)
            fine = ~bad.any(axis=1)
            x[todo[fine]] = trial[fine]
            todo, trial, bad = todo[~fine], trial[~fine], bad[~fine]
            if len(todo):
                here = x[todo]
                ratio = np.where(bad, here / np.where(bad, here - trial, 1.0), np.inf)
                ratio = np.where(bad & (here == trial), 0.0, ratio)
                share = ratio.min(axis=1)
                moved = here + share[:, None] * (trial - here)
                drop = bad & (ratio <= share[:, None])
                moved[drop] = 0.0
                x[todo] = moved
                passive[todo] &= ~drop
    else:
        raise RuntimeError(f"{len(open_rows)} non-negative systems of {n} unknowns are not solved after {max(400, 20 * n)} rounds")
    return x


def _solve_batch(grams: np.ndarray, rhs: np.ndarray, passive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least squares on each system's own passive unknowns, one batch per set; flags the systems that have no solution."""
    out, lost = np.zeros_like(rhs), np.zeros(len(rhs), dtype=bool)
    sets, member = np.unique(np.packbits(passive, axis=1), axis=0, return_inverse=True)
    member = member.reshape(-1)
    order = np.argsort(member, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(member[order])) + 1):
        at = np.flatnonzero(passive[rows[0]])
        if not len(at):
            continue
        systems = grams[rows[:, None, None], at[:, None], at[None, :]]
        try:
            out[rows[:, None], at] = np.linalg.solve(systems, rhs[rows[:, None], at][:, :, None])[:, :, 0]
        except np.linalg.LinAlgError:  # one singular system stops its batch
            ranks = np.linalg.matrix_rank(systems, hermitian=True)
            sound = ranks == len(at)
            lost[rows[~sound]] = True
            if sound.any():
                good = rows[sound]
                out[good[:, None], at] = np.linalg.solve(systems[sound], rhs[good[:, None], at][:, :, None])[:, :, 0]
    return out, lost


def solve_nonnegative_batch(grams: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Minimise ``x'Gx/2 - b'x`` over ``x >= 0`` for stacked systems, each with a matrix of its own.

    Block principal pivoting: all unknowns that violate a condition change sides at once, and systems with equal sets
    of free unknowns are solved in one batch. When the number of violations has not fallen for three exchanges, only the
    last of them changes, which is sure to end. Systems that are singular, or whose solution does not meet the conditions
    to rounding, go to ``solve_nonnegative`` one by one.
    """
    count, n = rhs.shape
    x, passive = np.zeros((count, n)), np.zeros((count, n), dtype=bool)
    scale = 1e-10 * np.maximum(np.abs(rhs).max(axis=1, initial=0.0), 1e-300)
    chances, fewest = np.full(count, 3), np.full(count, n + 1)
    slow = np.zeros(count, dtype=bool)
    todo = np.arange(count)
    for _ in range(max(100, 10 * n)):
        if not len(todo):
            break
        found, lost = _solve_batch(grams[todo], rhs[todo], passive[todo])
        slope = np.einsum("kij,kj->ki", grams[todo], found) - rhs[todo]
        free = passive[todo]
        wrong = np.where(free, found < 0, slope < -scale[todo][:, None])
        bad = wrong.sum(axis=1)
        finite = np.isfinite(found).all(axis=1) & ~lost
        slow[todo[~finite]] = True
        done = finite & (bad == 0)
        met = np.abs(np.where(free, slope, 0.0)).max(axis=1, initial=0.0) <= 1e3 * scale[todo]
        x[todo[done & met]] = found[done & met]
        slow[todo[done & ~met]] = True
        going = finite & (bad > 0)
        rows, wrong, bad = todo[going], wrong[going], bad[going]
        fewer = bad < fewest[rows]
        fewest[rows[fewer]], chances[rows[fewer]] = bad[fewer], 3
        chances[rows[~fewer]] -= 1
        single = chances[rows] < 0
        last = n - 1 - np.argmax(wrong[:, ::-1], axis=1)
        change = np.where(single[:, None], np.arange(n) == last[:, None], wrong)
        passive[rows] ^= change
        todo = rows
    slow[todo] = True
    for i in np.flatnonzero(slow):
        x[i] = solve_nonnegative(grams[i], rhs[i : i + 1])[0]
    return x


def _wide_sums(rows: DataFrame, n: int, keys: Sequence[str]) -> DataFrame:
    """``(keys…, at, total)``: the cells of ``X'X`` and ``X'y``, as matrix products within partitions."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            flat = np.concatenate(list(sums.values())) if sums else np.empty(0)
            size = n * n + n
            each = [pa.array([k[i] for k in sums for _ in range(size)], kinds[i]) for i in range(len(keys))]
            at = np.tile(np.arange(size, dtype=np.int32), len(sums))
            sums.clear()
            return pa.RecordBatch.from_arrays([*each, pa.array(at), pa.array(flat)], names=[*keys, "at", "total"])

        kinds: list[pa.DataType] = []
        for batch in batches:
            kinds = [batch.schema.field(i).type for i in range(len(keys))]
            x = matrix_from_lists(batch.column(len(keys)), n + 1)
            where = pa.table([*batch.columns[: len(keys)], pa.array(np.arange(batch.num_rows))], names=[*keys, "row_at"])
            groups = where.group_by(list(keys)).aggregate([("row_at", "list")]) if keys else None
            parts = zip(zip(*[groups[k].to_pylist() for k in keys]), groups["row_at_list"].to_pylist()) if keys else [((), slice(None))]
            for key, at in parts:
                part = x[at]
                total = (part[:, :n].T @ part).T  # the last row is X'y
                sums[key] = sums.get(key, 0.0) + total.reshape(-1)
            if len(sums) * n * n > 4_000_000:
                yield flush()
        if sums:
            yield flush()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keys)])
    partial = rows.mapInArrow(add, f"{fields}{', ' if keys else ''}at int, total double")
    return partial.groupBy(*keys, "at").agg(F.sum("total").alias("total"))


#: More columns than this are summed as matrix products
WIDE = 16


def gram_matrix(df: DataFrame, columns: Sequence[str], target: str, keys: Sequence[str] = ()) -> DataFrame:
    """The normal equations ``(ata, atb)`` over scalar columns, one row per group of ``keys``.

    Sums are partial within partitions first, so one huge group is no slower than many small ones. Beyond
    ``WIDE`` columns, where a sum of its own for every cell is no plan any more, they are matrix products.
    Rows with a null are left out.
    """
    n = len(columns)
    if n > WIDE:
        sound = df.dropna(subset=[*columns, target])
        values = F.array(*[F.col(c).cast("double") for c in [*columns, target]]).alias("values")
        cells = _wide_sums(sound.select(*keys, values), n, keys).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("at", "total"))).alias("cells"))
        return cells.where(F.size("cells") > 0).select(
            *keys, F.slice("cells.total", 1, n * n).alias("ata"), F.slice("cells.total", n * n + 1, n).alias("atb")
        )
    xs = [F.col(c).cast("double") for c in columns]
    y = F.col(target).cast("double")
    upper = {(i, j): F.sum(xs[i] * xs[j]).alias(f"g_{i}_{j}") for i in range(n) for j in range(i, n)}
    right = [F.sum(x * y).alias(f"b_{i}") for i, x in enumerate(xs)]
    sums = df.dropna(subset=[*columns, target]).groupBy(*keys).agg(*upper.values(), *right)
    cells = [F.col(f"g_{min(i, j)}_{max(i, j)}") for i in range(n) for j in range(n)]
    return sums.select(*keys, F.array(*cells).alias("ata"), F.array(*[F.col(f"b_{i}") for i in range(n)]).alias("atb"))


def solve_systems(systems: DataFrame, size: int, output: str = "x") -> DataFrame:
    """Append the non-negative solution of every row's system ``(ata, atb)``."""

    @F.arrow_udf("array<double>")
    def solve(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for ata, atb in batches:
            grams = matrix_from_lists(ata, size * size).reshape(-1, size, size)
            rhs = matrix_from_lists(atb, size)
            yield lists_from_matrix(solve_nonnegative_batch(grams, rhs))

    return systems.withColumn(output, solve("ata", "atb"))


def nnls_fit(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """One fit over the whole table: ``(ata, atb, x)``."""
    return solve_systems(gram_matrix(df, columns, target), len(columns))


def nnls_by_group(df: DataFrame, keys: Sequence[str], columns: Sequence[str], target: str) -> DataFrame:
    """One fit per group: the keys, ``ata``, ``atb`` and ``x``."""
    return solve_systems(gram_matrix(df, columns, target, keys), len(columns))


def unmix(df: DataFrame, endmembers: np.ndarray, features: str = "features", output: str = "abundance") -> DataFrame:
    """Append every pixel's non-negative abundances of the endmembers, one per row of the matrix.

    All pixels share one Gram matrix as wide as the number of endmembers; a batch costs one
    matrix product and a few small solves.
    """
    members = np.ascontiguousarray(endmembers, dtype=np.float64)
    gram = members @ members.T

    @F.arrow_udf("array<double>")
    def solve(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            pixels = matrix_from_lists(batch, members.shape[1])
            yield lists_from_matrix(solve_nonnegative(gram, pixels @ members.T))

    return df.withColumn(output, solve(feature_array(df, features, members.shape[1])))
