"""Mixing sources to target weights by balanced sampling with the cube method.

A source's target over its size says how often its documents are taken: the whole part for every document, the rest as
the probability of once more. Which documents these are is drawn by the cube method: three probabilities at a time move
along the direction that changes neither the sum of the probabilities nor that of the words they stand for, until one of
them is 0 or 1, so that documents and words stay balanced to the end. Every part of a source leaves two undecided
documents at most; these go on to a next round, until one part is left and the last two are landed.
"""

from __future__ import annotations

import random
from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandnet.llm.storage import release, stored
from bandnet.llm.textbytes import give_back

WEIGHTS, MOST_COPIES, PART_ROWS = (5.0, 2.0, 1.0), 3, 65_536
#: So many of a source's largest documents are landed together with what the flight leaves
LANDING = 10
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(
    sizes: DataFrame, source: str = "source", size: str = "size", weights: Sequence[float] = WEIGHTS, most: int = MOST_COPIES
) -> DataFrame:
    """``(source, source_rows, source_size, target)``: the share of all sizes that each source gets.

    Sources in code-point order, null last, weigh ``weights`` in turn. A target stops at ``most`` times the source's
    size, and what is over goes to the others by weight. Null sizes count as 0. One row per source; no rows give none.
    """
    totals = sizes.groupBy(F.col(source).alias("source")).agg(
        F.count(F.lit(1)).alias("source_rows"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("source_size")
    )
    place = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = totals.withColumn("weight", F.get(cycle, ((F.row_number().over(place) - 1) % len(weights)).cast("int")))
    # Sources reach their limits in the order of limit per weight. With those before it at their limits, a source is at
    # its own if its share of what is left is as large; the first that is not ends the series.
    limit = F.lit(most) * F.col("source_size")
    by_limit = Window.orderBy(limit / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    from_here = by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    series = weighed.select(
        "*",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(before), F.lit(0))).alias("left"),
        F.sum("weight").over(from_here).alias("weight_left"),
    ).withColumn("limited", F.col("left") * F.col("weight") >= limit * F.col("weight_left"))
    open_from = Window.orderBy(limit / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended = series.withColumn("is_open", F.max((~F.col("limited")).cast("int")).over(open_from) == 1)
    rest = F.first(F.when(F.col("is_open"), F.struct("left", "weight_left")), ignorenulls=True).over(
        by_limit.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    share = F.col("rest.left").cast("double") * F.col("weight") / F.col("rest.weight_left")
    return ended.withColumn("rest", rest).select(
        "source", "source_rows", "source_size", F.when(F.col("is_open"), F.least(share, limit.cast("double"))).otherwise(limit.cast("double")).alias("target")
    )


def move(units: list[list], direction: Sequence[float], uniform: float) -> None:
    """Move the probabilities (second entries) along a direction or against it until one is 0 or 1, keeping their means."""
    ahead = back = float("inf")
    stop_ahead = stop_back = None
    for unit, u in zip(units, direction, strict=True):
        if u:
            p = unit[1]
            up, down = ((1.0 - p) / u, p / u) if u > 0 else (p / -u, (1.0 - p) / -u)
            if up < ahead:
                ahead, stop_ahead = up, (unit, 1.0 if u > 0 else 0.0)
            if down < back:
                back, stop_back = down, (unit, 0.0 if u > 0 else 1.0)
    step, (last, end) = (ahead, stop_ahead) if uniform * (ahead + back) < back else (-back, stop_back)
    for unit, u in zip(units, direction, strict=True):
        unit[1] = min(1.0, max(0.0, unit[1] + step * u))
    last[1] = end


def balanced_choice(units: Iterator[tuple], draw: random.Random, land: bool) -> Iterator[tuple]:
    """Decide units ``(size, probability, ...)`` in their order; yields ``(unit, probability)``, 0 or 1 if decided.

    At most three units are in flight. Without ``land`` two may come back undecided. With it the last ``LANDING`` units
    wait for those two, and ``landed`` decides them together.
    """
    flying: list[list] = []
    waiting: deque[tuple] = deque()

    def leave() -> Iterator[tuple]:
        for unit in [u for u in flying if u[1] in (0.0, 1.0)]:
            flying.remove(unit)
            yield unit[2], unit[1]

    for unit in units:
        if unit[1] in (0.0, 1.0):
            yield unit, unit[1]
            continue
        waiting.append(unit)
        if land and len(waiting) <= LANDING:
            continue
        unit = waiting.popleft()
        flying.append([unit[0], unit[1], unit])
        if len(flying) == 3:
            a, b, c = (u[0] for u in flying)
            move(flying, (c - b, a - c, b - a) if not a == b == c else (1, -1, 0), draw.random())
            yield from leave()
    flying += [[unit[0], unit[1], unit] for unit in waiting]
    if land:
        for unit, p in zip(flying, landed([u[0] for u in flying], [u[1] for u in flying]), strict=True):
            unit[1] = p
    yield from ((unit[2], unit[1]) for unit in flying)


def landed(sizes: Sequence[int], chances: Sequence[float]) -> list[float]:
    """Whole numbers in place of a few probabilities.

    Of all choices whose number of units is less than one off, the one whose sizes come nearest to what the probabilities
    stand for; of equals the most probable, then the one that takes earlier units.
    """
    n = len(sizes)
    if not n:
        return []
    p, size = np.array(chances), np.array(sizes, dtype=float)
    every = (np.arange(1 << n)[:, None] >> np.arange(n)) & 1
    off = np.abs(every @ size - p @ size)
    off[np.abs(every.sum(axis=1) - p.sum()) >= 1] = np.inf
    likely = every @ np.log(p) + (1 - every) @ np.log1p(-p)
    nearest = np.flatnonzero(off <= off.min() + 1e-9)
    return every[nearest[np.argmax(np.round(likely[nearest], 9))]].astype(float).tolist()


def _decider(schema: pa.Schema, seed: int, level: int):
    names = schema.names
    at = {name: names.index(name) for name in ("size", "chance", "place", "part", "parts")}

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*[unit[2] for unit, _ in out], strict=True)) or [[] for _ in names]
            columns[at["chance"]] = [p for _, p in out]
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            out.clear()
            return made

        stream = rows()
        row = next(stream, None)
        while row is not None:
            group = (row[at["place"]], row[at["part"]])
            following: list = [None]

            def members(row=row, group=group, following=following) -> Iterator[tuple]:
                while row is not None and (row[at["place"]], row[at["part"]]) == group:
                    yield row[at["size"]], row[at["chance"]], row
                    row = next(stream, None)
                following[0] = row

            draw = random.Random(f"{seed}:{level}:{group[0]}:{group[1]}")
            for decision in balanced_choice(members(), draw, row[at["parts"]] == 1):
                out.append(decision)
                if len(out) >= 8192:
                    yield batch_of()
            row = following[0]
        if out:
            yield batch_of()
        give_back()

    return decide


def mix_sources(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = WEIGHTS,
    most: int = MOST_COPIES,
    seed: int = 42,
    part_rows: int = PART_ROWS,
    word: str = WORD,
) -> DataFrame:
    """How often to take every document so that each source gives its share of all words.

    Returns the columns ``key`` and ``source`` and then ``size`` (words of the text), ``source_size``, ``target`` (see
    ``source_targets``), ``copies`` (0 to ``most``) and ``taken`` (words). Every source's ``taken`` is its target but for
    what a choice among twelve documents cannot even out, and no document is taken more than once oftener than another of
    its source. All but those twelve are taken with the probability that the target asks for. Draws depend on the seed, the keys
    and the sizes, not on the layout of the table.

    Null and empty texts have no words and count as documents; a source without words has target 0; rows that are equal
    are decided each by itself; null keys are keys like others; very long texts are documents like others, decided last;
    an empty table gives an empty one. Other columns of the table do not matter, whatever their names.
    """
    if not weights or min(weights) <= 0 or most < 1 or part_rows < 3:
        raise ValueError("weights must be positive, most at least 1, part_rows at least 3")
    size = F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(word)), F.lit(0)).cast("long")
    sizes = stored(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), F.greatest(size, F.lit(0)).alias("size")), "sizes")
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    targets = source_targets(sizes, weights=weights, most=most)
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = stored(
        targets.withColumn("place", F.row_number().over(by_source))
        .withColumn("times", times)
        .withColumn("parts", F.ceil(F.col("source_rows") / part_rows)),
        "targets",
    )
    chance = F.col("times") - F.floor("times")
    # The table of sources is stored, so that Spark knows its size and broadcasts it only when it is small
    joined = sizes.join(targets.withColumnRenamed("source", "source_of"), F.col("source").eqNullSafe(F.col("source_of")))
    level = 0
    undecided = joined.select(
        "key", "source", "size", "source_size", "target", F.floor("times").cast("long").alias("copies"),
        chance.alias("chance"), "place", "parts", _part(level, seed).alias("part"),
    )
    decided: list[DataFrame] = []
    parts = targets.agg(F.max("parts")).first()[0] or 1
    while True:
        order = ["place", "part", "size", F.xxhash64(F.lit(seed), "key"), "key"]
        ordered = undecided.repartition("place", "part").sortWithinPartitions(*order)
        arrow = _arrow_schema(ordered)
        made = stored(ordered.mapInArrow(_decider(arrow, seed, level), ordered.schema), "decisions")
        decided.append(made.where("chance IN (0, 1)"))
        if parts == 1:
            break
        level += 1
        # Every part leaves two rows at most
        fewer = F.ceil(2 * F.col("parts") / part_rows)
        rest = made.where("chance NOT IN (0, 1)").withColumn("parts", F.when(F.col("parts") > 1, fewer).otherwise(1))
        undecided = rest.withColumn("part", _part(level, seed))
        parts = -(-2 * parts // part_rows)
    release(sizes, targets)
    every = decided[0]
    for one in decided[1:]:
        every = every.unionByName(one)
    copies = F.col("copies") + F.col("chance").cast("long")
    return every.select(
        F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target",
        copies.alias("copies"), (copies * F.col("size")).alias("taken"),
    )


def _part(level: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "key", "size"), F.col("parts"))


def _arrow_schema(df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.schema)
