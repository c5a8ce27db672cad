"""Evaluation: aggregates over scored tables. No row reaches the driver."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandnet.functions import feature_array, squared_error


def _mse(df: DataFrame, features: str, prediction: str) -> Column:
    """Squared error over the values of rows that have both columns; unequal lengths are an error."""
    actual, scored = feature_array(df, features), feature_array(df, prediction)
    both = actual.isNotNull() & scored.isNotNull()
    uneven = F.raise_error(F.format_string("%d values against a prediction of %d", F.size(actual), F.size(scored)))
    error = F.when(F.size(actual) == F.size(scored), squared_error(actual, scored)).otherwise(uneven)
    return F.sum(F.when(both, error)) / F.sum(F.when(both, F.size(actual)))


def reconstruction_mse(df: DataFrame, features: str = "features", prediction: str = "prediction") -> DataFrame:
    """A one-row table ``(mse)``: squared error over all values; null for an empty table."""
    return df.agg(_mse(df, features, prediction).alias("mse"))


def fold_mse(df: DataFrame, fold: str = "fold", features: str = "features", prediction: str = "prediction") -> DataFrame:
    """Error and row count by fold, all folds in one pass."""
    return df.groupBy(fold).agg(_mse(df, features, prediction).alias("mse"), F.count(F.lit(1)).alias("n"))


def mean_fold_mse(df: DataFrame, fold: str = "fold", features: str = "features", prediction: str = "prediction") -> DataFrame:
    """A one-row table ``(mse)``: the unweighted mean of the folds' errors."""
    return fold_mse(df, fold, features, prediction).agg(F.avg("mse").alias("mse"))


def _hits(prediction: str, label: str) -> Column:
    """1.0 for a hit; a row without prediction or label is a miss."""
    return F.coalesce((F.col(prediction).cast("double") == F.col(label).cast("double")).cast("double"), F.lit(0.0))


def accuracy(df: DataFrame, prediction: str = "prediction", label: str = "label") -> DataFrame:
    """A one-row table ``(accuracy, n)``."""
    return df.agg(F.avg(_hits(prediction, label)).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def accuracy_by_label(df: DataFrame, prediction: str = "prediction", label: str = "label") -> DataFrame:
    """Accuracy and row count by label; partial sums keep a dominant label cheap."""
    return df.groupBy(label).agg(F.avg(_hits(prediction, label)).alias("accuracy"), F.count(F.lit(1)).alias("n"))


class ReconstructionEvaluator(Evaluator, DefaultParamsReadable, DefaultParamsWritable):
    """Mean squared reconstruction error as a ``pyspark.ml`` evaluator; smaller is better."""

    featuresCol = Param(Params._dummy(), "featuresCol", "features column", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "reconstruction column", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, featuresCol: str = "features", predictionCol: str = "prediction") -> None:
        super().__init__()
        self._setDefault(featuresCol="features", predictionCol="prediction")
        self._set(**self._input_kwargs)

    def _evaluate(self, dataset: DataFrame) -> float:
        row = reconstruction_mse(
            dataset, self.getOrDefault(self.featuresCol), self.getOrDefault(self.predictionCol)
        ).first()
        return float("nan") if row["mse"] is None else float(row["mse"])

    def isLargerBetter(self) -> bool:
        return False
