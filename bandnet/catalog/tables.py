"""The given tables in the shapes the catalogue's queries use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as ``(id, features, label)``."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("features"), "label"
    )


LINEAR_FEATURES = ["x0", "x1", "x2", "x3"]
# The same four features, as SQL both engines read alike.
LINEAR_SQL = {
    "x0": "l_quantity / 50::double",
    "x1": "l_extendedprice / 100000::double",
    "x2": "l_discount * 10::double",
    "x3": "l_tax * 10::double",
}
FLAG_SQL = "CASE WHEN l_linestatus = 'F' THEN 1::double ELSE 0::double END"
CLASS_SQL = "CASE l_returnflag WHEN 'A' THEN 0::double WHEN 'N' THEN 1::double ELSE 2::double END"
# A target that depends on the features and can be negative
TARGET_SQL = "l_discount * 5 - l_quantity / 100 + l_linenumber / 10"


def line_rows(spark: SparkSession, folder: str, *more: Column) -> DataFrame:
    """Line items as four features near [0, 1], a flag, a class, and a numeric target; then ``more`` columns."""
    items = table(spark, folder, "lineitem")
    return items.select(
        *[F.expr(sql).alias(name) for name, sql in LINEAR_SQL.items()],
        F.expr(FLAG_SQL).alias("flag"),
        F.expr(CLASS_SQL).alias("class"),
        F.expr(TARGET_SQL).alias("target"),
        "l_returnflag",
        *more,
    )


LINE_ROWS_SQL = (
    "rows AS MATERIALIZED (SELECT "
    + ", ".join(f"{sql} AS {name}" for name, sql in LINEAR_SQL.items())
    + f", {FLAG_SQL} AS flag, {CLASS_SQL} AS class, {TARGET_SQL} AS target, l_returnflag FROM lineitem)"
)


def rounded(column: str | Column, digits: int = 6) -> Column:
    """Rounded for comparison, with a negative zero turned into zero."""
    value = F.col(column) if isinstance(column, str) else column
    return F.round(value, digits) + F.lit(0.0)
