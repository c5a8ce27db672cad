"""Image cubes: long tables ``(row, col, band, value)`` and pixel tables ``(row, col, features)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIXEL = ("row", "col")


def _whole(col: Column, size: int) -> Column:
    """Whole-number division; a quotient of doubles would lose the last digits of large positions."""
    return F.call_function("div", col, F.lit(size))


def cube_cells(
    cells: DataFrame, height: int, width: int, bands: int, channels_last: bool = True, position: str = "position"
) -> DataFrame:
    """Add ``row``, ``col`` and ``band`` to cells numbered in storage order.

    Channels-last images store all bands of a pixel together; channels-first images store one
    whole plane per band.
    """
    at = F.col(position)
    if channels_last:
        pixel, band = _whole(at, bands), at % bands
    else:
        pixel, band = at % (height * width), _whole(at, height * width)
    return cells.withColumns(
        {
            "row": _whole(pixel, width).cast("int"),
            "col": (pixel % width).cast("int"),
            "band": band.cast("int"),
        }
    )


def cube_to_pixels(
    cube: DataFrame, unique: bool = True, bands: int | None = None, fill: float | None = None
) -> DataFrame:
    """One row per pixel with its values in band order.

    Copies of a cell collapse before the shuffle, so a pixel's group never outgrows its distinct
    cells however often the table repeats them. Two different values for one cell are an error;
    with ``unique=False`` the largest one wins instead. A pixel must have all bands from 0 to
    ``bands`` - 1, by default to the last one it has; a missing cell is an error unless ``fill`` gives
    its value, for which ``bands`` is needed. A null band is an error too.
    """
    if fill is not None and bands is None:
        raise ValueError("fill needs the number of bands")
    if not unique:
        cube = cube.groupBy(*PIXEL, "band").agg(F.max("value").alias("value"))
    grouped = cube.groupBy(*PIXEL).agg(F.sort_array(F.collect_set(F.struct("band", "value"))).alias("cells"))
    clean = F.size(F.array_distinct("cells.band")) == F.size("cells")
    expected = F.lit(bands) if bands is not None else F.array_max("cells.band") + 1
    inside = F.coalesce(F.forall("cells.band", lambda b: (b >= 0) & (b < expected)), F.lit(False))
    values = F.col("cells.value")
    if fill is not None:
        known = F.map_from_entries("cells")
        values = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.coalesce(F.get(F.map_values(known), F.array_position(F.map_keys(known), b).cast("int") - 1), F.lit(fill).cast("double")))
    else:
        inside = inside & (F.size("cells") == expected)
    two = F.raise_error(F.format_string("pixel (%d, %d) has two values for one band", *PIXEL))
    gap = F.raise_error(F.format_string("pixel (%d, %d) lacks a band or has one out of range", *PIXEL))
    return grouped.select(*PIXEL, F.when(~clean, two).when(inside, values).otherwise(gap).alias("features"))


def pixels_to_cube(pixels: DataFrame, features: str = "features") -> DataFrame:
    """The inverse of ``cube_to_pixels``, without a shuffle."""
    return pixels.select(*PIXEL, F.posexplode(features).alias("band", "value"))


def attach_labels(pixels: DataFrame, truth: DataFrame, label: str = "label") -> DataFrame:
    """Pixels with their ground-truth label in front; pixels without one keep a null label.

    Copies in the truth table collapse before the join, so no pixel is repeated; two different
    labels for one pixel are an error. The join is left to Spark: a small truth table is broadcast
    by its measured size, a large one is shuffled on the pixel key.
    """
    rest = [c for c in pixels.columns if c not in PIXEL]
    found = truth.groupBy(*PIXEL).agg(F.min(label).alias("low"), F.max(label).alias("high"))
    one = F.when(F.col("low").eqNullSafe(F.col("high")), F.col("low")).otherwise(
        F.raise_error(F.format_string("pixel (%d, %d) has two labels", *PIXEL))
    )
    labels = found.select(*PIXEL, one.alias(label))
    return pixels.join(labels, list(PIXEL), "left").select(*PIXEL, label, *rest)


def pixel_lines(
    pixels: DataFrame, features: str = "features", label: str | None = None, position: bool = False
) -> DataFrame:
    """Pixels as CSV lines in a column ``value``: row and column and the label if asked for, then every band."""
    bands = F.array_join(F.col(features).cast("array<string>"), ",")
    parts = [F.coalesce(F.col(label).cast("string"), F.lit("")), bands] if label else [bands]
    where = [F.col(c).cast("string") for c in PIXEL] if position else []
    return pixels.select(F.concat_ws(",", *where, *parts).alias("value"))


def write_pixels_csv(
    pixels: DataFrame, path: str, features: str = "features", label: str | None = None, mode: str = "error",
    position: bool = False,
) -> None:
    """Write pixels as header-less CSV files, one per partition; ``position`` puts row and column in front."""
    pixel_lines(pixels, features, label, position).write.mode(mode).text(path)
