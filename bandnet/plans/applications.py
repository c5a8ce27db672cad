"""The two end-to-end jobs: train and score a classifier, train and score an autoencoder."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import MinMaxScaler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandnet.functions import feature_array
from bandnet.models import DenseAutoencoder, DenseAutoencoderModel, DenseClassifier, DenseClassifierModel
from bandnet.operators.evaluation import accuracy, mean_fold_mse
from bandnet.operators.optimizers import Fit
from bandnet.operators.scaling import Bounds, minmax_column, minmax_fit, minmax_scale
from bandnet.operators.splits import DEFAULT_SEED, k_folds, random_split, split_by_key, split_rows
from bandnet.sources import read_libsvm

# The layer sizes the two jobs use unless told otherwise.
CLASSIFIER_LAYERS = [200, 128, 64, 32, 17]
AUTOENCODER_LAYERS = [220, 140, 60, 140, 220]
BLOCK_SIZE = 256


@dataclass(frozen=True)
class ApplicationResult:
    """A fitted model, its scored test rows and a one-row table of the job's figure."""

    model: DenseClassifierModel | DenseAutoencoderModel
    predictions: DataFrame
    metrics: DataFrame


def _table(spark: SparkSession, source: str | DataFrame, width: int) -> DataFrame:
    return read_libsvm(spark, source, width) if isinstance(source, str) else source


def train_test(df: DataFrame, train_fraction: float, key: str | None, seed: int = DEFAULT_SEED) -> tuple[DataFrame, DataFrame]:
    """Two parts: by the key's hash where there is a key, otherwise by the rows themselves."""
    if not 0 < train_fraction < 1:
        raise ValueError("train_fraction must be between 0 and 1")
    if key is None:
        train, test = random_split(df, [train_fraction, 1 - train_fraction], seed)
        return train, test
    marked = split_by_key(df, key, [train_fraction, 1 - train_fraction])
    return marked.where("split = 0").drop("split"), marked.where("split = 1").drop("split")


def prepare(
    df: DataFrame, train_fraction: float, key: str | None = None, fit_on: str = "all", seed: int = DEFAULT_SEED
) -> tuple[DataFrame, DataFrame]:
    """Scale the features to [0, 1] and split.

    By default the bounds come from all rows, test rows included; ``fit_on="train"`` keeps the
    test rows out of them.
    """
    if fit_on not in ("all", "train"):
        raise ValueError("fit_on must be 'all' or 'train'")
    if fit_on == "all":
        return train_test(_scaler(df)(df), train_fraction, key, seed)
    train, test = train_test(df, train_fraction, key, seed)
    scale = _scaler(train)
    return scale(train), scale(test)


def _scaler(df: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A function that scales the features by the bounds of ``df``.

    Vectors go through Spark's own scaler, which is the fastest way for them; arrays stay arrays.
    """
    if isinstance(df.schema["features"].dataType, VectorUDT):
        fitted = MinMaxScaler(inputCol="features", outputCol="scaledFeatures").fit(df)
        return lambda part: fitted.transform(part).drop("features").withColumnRenamed("scaledFeatures", "features")
    bounds = minmax_fit(df)
    return lambda part: minmax_scale(part, bounds)


def _marked(df: DataFrame, train_fraction: float, key: str | None, seed: int) -> DataFrame:
    """The table with a boolean column ``in_train``."""
    if not 0 < train_fraction < 1:
        raise ValueError("train_fraction must be between 0 and 1")
    fractions = [train_fraction, 1 - train_fraction]
    marked = split_by_key(df, key, fractions) if key is not None else split_rows(df, fractions, seed)
    return marked.withColumn("in_train", F.col("split") == 0).drop("split")


def _scaled_test(marked: DataFrame, fit: Fit) -> DataFrame:
    """The rows not trained on, with the features mapped by the bounds that training found."""
    test = marked.where(~F.col("in_train")).drop("in_train")
    if fit.bounds is None:
        return test
    scaled = minmax_column(feature_array(test, "features"), Bounds(*fit.bounds))
    if isinstance(test.schema["features"].dataType, VectorUDT):
        scaled = array_to_vector(scaled)
    return test.withColumn("features", scaled)


def run_classification(
    spark: SparkSession,
    source: str | DataFrame,
    train_fraction: float = 0.8,
    max_iter: int = 100,
    layers: Sequence[int] = tuple(CLASSIFIER_LAYERS),
    key: str | None = None,
    fit_on: str = "all",
    seed: int = DEFAULT_SEED,
    **options,
) -> ApplicationResult:
    """Load, scale, split, train a classifier and report its test accuracy.

    ``source`` is a libsvm path or a table ``(label, features)``; with ``key`` the table's split
    follows that column, otherwise the rows themselves. Training reads the source once. ``seed`` decides the initial weights and, without a key, the split.
    Further options are parameters of ``DenseClassifier``.
    """
    marked = _marked(_table(spark, source, layers[0]), train_fraction, key, seed)
    settings = {"blockSize": BLOCK_SIZE, "seed": seed, "maxIter": max_iter, **options}
    model, fit = DenseClassifier(layers=list(layers), **settings).fit_part(marked, "in_train", fit_on)
    predictions = model.transform(_scaled_test(marked, fit))
    return ApplicationResult(model, predictions, accuracy(predictions))


def run_autoencoder(
    spark: SparkSession,
    source: str | DataFrame,
    train_fraction: float = 0.8,
    max_iter: int = 400,
    layers: Sequence[int] = tuple(AUTOENCODER_LAYERS),
    folds: int = 4,
    key: str | None = None,
    fit_on: str = "all",
    seed: int = DEFAULT_SEED,
    **options,
) -> ApplicationResult:
    """Load, scale, split, train an autoencoder and report the mean error over test folds."""
    marked = _marked(_table(spark, source, layers[0]), train_fraction, key, seed)
    settings = {"blockSize": BLOCK_SIZE, "seed": seed, "maxIter": max_iter, **options}
    model, fit = DenseAutoencoder(layers=list(layers), **settings).fit_part(marked, "in_train", fit_on)
    test = _scaled_test(marked, fit)
    folded = k_folds(test, key, folds) if key is not None else split_rows(test, [1.0] * folds, seed + 1, "fold")
    predictions = model.transform(folded)
    return ApplicationResult(model, predictions, mean_fold_mse(predictions))

