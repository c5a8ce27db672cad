"""Contiguous shards of nearly equal size from global prefix sums.

Rows are laid out in one global order by range partitioning. Every partition adds up its own rows; the totals of the
partitions (one row each, however large the table) become prefix sums; and the line of all sizes is cut at equal
targets. No step sorts or counts more than a partition, and a key with many rows is spread by the tie-breakers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bandnet.llm.storage import fresh_name, stored


def balanced_shards(rows: DataFrame, order: list[str], size: str, shards: int = 8) -> DataFrame:
    """Add ``shard`` (int) and ``slot`` (long, gapless from 0 within a shard).

    ``order`` names the columns of the global order and ``size`` a non-negative long column. A row goes where the
    middle of its stretch of the line falls, so a shard differs from its target by at most the largest row.
    Null keys come first; null sizes count as 0; rows that agree in all of ``order`` keep the order of the input;
    an empty table gives an empty result; columns named shard or slot are replaced, all others stay.
    With all sizes 0, rows are cut evenly by count.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    rows = rows.drop("shard", "slot")
    tie, part, before, index = fresh_name(rows, "tie", "part", "before", "index")
    laid = rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*order, tie)
    laid = laid.sortWithinPartitions(*order, tie).drop(tie)
    columns = laid.columns

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, total, count = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            sizes = np.asarray(batch.column(columns.index(size)).fill_null(0), dtype=np.int64)
            sums = np.cumsum(sizes)
            arrays = [
                *batch.columns,
                pa.array(np.full(len(sizes), number, dtype=np.int32)),
                pa.array(total + sums - sizes),
                pa.array(count + np.arange(len(sizes), dtype=np.int64)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, part, before, index])
            total, count = total + int(sizes.sum()), count + len(sizes)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in laid.schema)
    laid = stored(laid.mapInArrow(running, f"{fields}, `{part}` int, `{before}` long, `{index}` long"), "shard-line")

    weight = F.coalesce(F.col(size), F.lit(0))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bytes_before, rows_before, all_bytes, all_rows, b, n = fresh_name(
        laid, "bytes_before", "rows_before", "all_bytes", "all_rows", "b", "n"
    )
    # One row for each partition of the layout
    totals = laid.groupBy(part).agg(F.sum(weight).alias(b), F.count(F.lit(1)).alias(n))
    totals = totals.select(
        part,
        F.coalesce(F.sum(b).over(earlier), F.lit(0)).alias(bytes_before),
        F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(rows_before),
        F.sum(b).over(everything).alias(all_bytes),
        F.sum(n).over(everything).alias(all_rows),
    )
    placed = laid.join(totals, part)
    place = F.col(rows_before) + F.col(index)
    # Decimals, since twice a byte count times the shards can pass the range of a long
    middle = ((F.col(bytes_before) + F.col(before)) * 2 + weight).cast("decimal(24,0)") * shards
    by_bytes = F.floor(middle / (F.col(all_bytes) * 2).cast("decimal(24,0)"))
    by_rows = F.floor(place * shards / F.col(all_rows))
    shard = F.least(F.lit(shards - 1), F.when(F.col(all_bytes) > 0, by_bytes).otherwise(by_rows).cast("int"))
    placed = placed.select(*columns, place.alias(index), shard.alias("shard"))
    (first,) = fresh_name(placed, "first")
    starts = placed.groupBy("shard").agg(F.min(index).alias(first))  # a row for each shard
    placed = placed.join(F.broadcast(starts), "shard")
    return placed.select(*columns, "shard", (F.col(index) - F.col(first)).alias("slot"))
