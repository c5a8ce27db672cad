"""libsvm text: reading it, and writing it from tables of text or numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_libsvm(spark: SparkSession, path: str, num_features: int | None = None) -> DataFrame:
    """A table ``(label, features)`` of libsvm files.

    Give ``num_features`` where it is known: without it Spark reads every file once more just to
    find the largest index.
    """
    reader = spark.read.format("libsvm")
    if num_features is not None:
        reader = reader.option("numFeatures", str(num_features))
    return reader.load(path)


def read_pixel_csv(spark: SparkSession, path: str, columns: int | None = None) -> DataFrame:
    """Header-less CSV pixel rows as text columns ``_c0, _c1, …``; ``columns`` saves a look at the file."""
    reader = spark.read.option("header", False)
    if columns is not None:
        reader = reader.schema(", ".join(f"_c{i} string" for i in range(columns)))
    return reader.csv(path)


def _number(text: Column) -> Column:
    """The value of a text; text that is no number is an error whatever the session's cast rules."""
    value = text.try_cast("double")
    return F.when(value.isNotNull(), value).otherwise(F.raise_error(F.concat(F.lit("not a number: "), text)))


def _label_text(label: Column) -> Column:
    text = label.cast("string")
    return (
        F.when(text.isNull() | (F.trim(text) == ""), F.raise_error(F.lit("a row has no label")))
        .when(_number(text) == 0.0, F.lit("0"))
        .otherwise(text)
    )


def csv_to_libsvm(df: DataFrame, label_col: str | int | None = 0, no_labels: bool = False) -> DataFrame:
    """Rows of separate columns as libsvm lines in a column ``value``.

    The label column (by name or position, the first by default) leads the line, written ``0``
    when it equals zero. Every other column becomes ``index:value`` with 1-based indexes and its
    text unchanged; empty and zero items are left out. With ``no_labels`` every column is a
    feature and the label is ``1``.
    """
    names = list(df.columns)
    if no_labels:
        label = F.lit("1")
    else:
        name = names.pop(label_col) if isinstance(label_col, int) else label_col
        if not isinstance(label_col, int):
            names.remove(name)
        label = _label_text(F.col(f"`{name}`"))
    items = F.array(*[F.col(f"`{n}`").cast("string") for n in names])
    numbered = F.transform(
        items,
        lambda item, i: F.when(
            item.isNotNull() & (item != "") & F.when(item != "", _number(item) != 0.0),
            F.concat((i + 1).cast("string"), F.lit(":"), item),
        ),
    )
    # concat_ws skips the nulls that stand for dropped items
    return df.select(F.concat_ws(" ", label, numbered).alias("value"))


def features_to_libsvm(df: DataFrame, features: str = "features", label: str = "label") -> DataFrame:
    """A ``(label, features)`` table as libsvm lines, for array features."""
    numbered = F.transform(
        F.col(features).cast("array<double>"),
        lambda v, i: F.when(v != 0.0, F.concat((i + 1).cast("string"), F.lit(":"), v.cast("string"))),
    )
    return df.select(F.concat_ws(" ", _label_text(F.col(label)), numbered).alias("value"))


def write_lines(lines: DataFrame, path: str, mode: str = "error") -> None:
    """Write a one-column text table, one file per partition."""
    lines.write.mode(mode).text(path)
