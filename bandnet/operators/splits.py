"""Splitting a table into parts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bandnet.functions import key_hash, row_digest
from bandnet.functions.columns import KEY_HASH_BITS

DEFAULT_SEED = 1234


def split_bounds(fractions: Sequence[float]) -> list[int]:
    """Where the parts after the first begin, in the range of the key hash."""
    if not fractions or any(f <= 0 for f in fractions):
        raise ValueError("fractions must be positive")
    total = float(sum(fractions))
    bounds, reached = [0], 0.0
    for f in fractions[:-1]:
        reached += f / total
        bounds.append(round(reached * 2**KEY_HASH_BITS))
    bounds.append(2**KEY_HASH_BITS)
    if any(a >= b for a, b in zip(bounds, bounds[1:])):
        raise ValueError("a fraction is too small to be told from nothing")
    return bounds[1:-1]


def split_by_key(
    df: DataFrame, key: str, fractions: Sequence[float], salt: str = "split", output: str = "split"
) -> DataFrame:
    """Add the number of the part each row belongs to, decided by its key alone.

    No shuffle and no sort, and the same answer on every layout. Parts are stretches of a hash of 60
    bits, so fractions down to a millionth of a millionth have their part. A null key is an error. Use a
    different ``salt`` for a split of a split, or the two are not independent.
    """
    bounds = F.array(*[F.lit(b) for b in split_bounds(fractions)]).cast("array<bigint>")
    return df.withColumn(output, F.size(F.filter(bounds, lambda b: b <= key_hash(key, salt))))


def k_folds(df: DataFrame, key: str, folds: int = 4, salt: str = "fold", output: str = "fold") -> DataFrame:
    """Add a fold number 0..folds-1, all folds alike in expected size; a null key is an error."""
    if folds < 1:
        raise ValueError("folds must be at least 1")
    return df.withColumn(output, (key_hash(key, salt) % folds).cast("int"))


def split_rows(df: DataFrame, fractions: Sequence[float], seed: int = DEFAULT_SEED, output: str = "split") -> DataFrame:
    """Add the number of the part each row belongs to, for tables without a key.

    A row is told by a digest of all its columns and, among rows equal in all of them, by its number: the split is the
    same on every layout of the table, and no partition is sorted. Only digests are shuffled to find those that come
    again, added up within partitions first; only rows that come again are dealt out by their digest and numbered, which
    is one task for all copies of a row. The table is read for the digests, the single rows and the repeated ones.
    """
    bounds = F.array(*[F.lit(b) for b in split_bounds(fractions)]).cast("array<bigint>")
    digest, number = "__row_digest", "__row_number"
    rows = df.withColumn(digest, row_digest(df))
    again = rows.groupBy(digest).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(digest)
    order = Window.partitionBy(digest).orderBy(digest)
    repeated = rows.join(again, digest, "left_semi").select(*df.columns, digest, F.row_number().over(order).alias(number))
    single = rows.join(again, digest, "left_anti").select(*df.columns, digest, F.lit(1).alias(number))
    told = key_hash(F.concat_ws(":", digest, F.col(number).cast("string")), f"rows-{seed}")
    part = F.size(F.filter(bounds, lambda b: b <= told))
    return single.union(repeated).select(*[c for c in df.columns if c != output], part.alias(output))


def random_split(df: DataFrame, fractions: Sequence[float], seed: int = DEFAULT_SEED) -> list[DataFrame]:
    """The parts of ``split_rows`` as tables of their own."""
    name = "split"
    while name in df.columns:
        name = "_" + name
    marked = split_rows(df, fractions, seed, name)
    return [marked.where(F.col(name) == i).drop(name) for i in range(len(fractions))]
