"""Min-max scaling of a feature column to [0, 1]."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandnet.functions import double_array_literal, feature_array


@dataclass(frozen=True)
class Bounds:
    """Smallest and largest value of every feature."""

    low: np.ndarray
    high: np.ndarray


def minmax_stats(df: DataFrame, features: str = "features") -> DataFrame:
    """A lazy table ``(band, low, high)``, one row per feature position.

    Each partition reduces its rows to one pair per position before the shuffle.
    """
    value = F.col("value").cast("double")
    return (
        df.select(F.posexplode(feature_array(df, features)).alias("band", "value"))
        .groupBy("band")
        .agg(F.min(value).alias("low"), F.max(value).alias("high"))
    )


def minmax_fit(df: DataFrame, features: str = "features") -> Bounds:
    """The bounds as driver arrays: two numbers per feature, whatever the table's size."""
    rows = sorted(minmax_stats(df, features).collect(), key=lambda r: r["band"])
    return Bounds(np.array([r["low"] for r in rows]), np.array([r["high"] for r in rows]))


def minmax_column(col: Column, bounds: Bounds) -> Column:
    """Values mapped so that the bounds become 0 and 1; outside values are not clipped.

    A feature whose bounds are equal becomes 0.5.
    """
    span = bounds.high - bounds.low
    flat = span == 0
    # (v - low) / span, and (v - v) / 1 + 0.5 for a constant feature
    low = double_array_literal(bounds.low)
    width = double_array_literal(np.where(flat, 1.0, span))
    scaled = F.transform(col, lambda v, i: (v.cast("double") - F.get(low, i)) / F.get(width, i))
    if not flat.any():
        return scaled
    constant = F.array(*[F.lit(bool(f)) for f in flat])
    return F.transform(scaled, lambda v, i: F.when(F.get(constant, i), F.lit(0.5)).otherwise(v))


def minmax_scale(df: DataFrame, bounds: Bounds, features: str = "features", output: str = "features") -> DataFrame:
    """Replace (or add) the scaled feature column."""
    return df.withColumn(output, minmax_column(feature_array(df, features), bounds))


def minmax_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Scale separate numeric columns to [0, 1] by one aggregate over the table."""
    stats = [F.min(F.col(c).cast("double")).alias(f"lo{i}") for i, c in enumerate(columns)]
    stats += [F.max(F.col(c).cast("double")).alias(f"hi{i}") for i, c in enumerate(columns)]
    found = df.agg(*stats).first()
    scaled = {}
    for i, c in enumerate(columns):
        low, high = found[f"lo{i}"], found[f"hi{i}"]
        if low is None:
            scaled[c] = F.col(c).cast("double")
        elif low == high:
            scaled[c] = F.when(F.col(c).isNotNull(), F.lit(0.5))
        else:
            scaled[c] = (F.col(c).cast("double") - F.lit(low)) / F.lit(high - low)
    return df.withColumns(scaled)
