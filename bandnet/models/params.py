"""Parameters, persistence and accessors shared by the estimators and their models."""

from __future__ import annotations

import math
import os
from collections.abc import Callable, Sequence
from typing import Any

import numpy as np
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import (
    HasBlockSize,
    HasFeaturesCol,
    HasLabelCol,
    HasMaxIter,
    HasPredictionCol,
    HasSeed,
    HasStepSize,
    HasTol,
)
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession

from bandnet.operators.optimizers import SMALLEST_TOL, Fit, Optimizer, Progress
from bandnet.operators.training import DEFAULT_SEED, SOLVERS, history_frame, weight_frame
from bandnet.operators.topology import Topology
from bandnet.operators.updaters import Updater


def _checked(convert: Callable[[Any], Any], ok: Callable[[Any], bool], message: str) -> Callable[[Any], Any]:
    def run(value: Any) -> Any:
        converted = convert(value)
        if not ok(converted):
            raise ValueError(f"{message}, got {value!r}")
        return converted

    return run


def _weight_list(value: Any) -> list[float]:
    """Weights of any vector-like kind as plain floats, so that they can be saved as JSON."""
    weights = [float(v) for v in (value.toArray() if hasattr(value, "toArray") else value)]
    if not all(math.isfinite(v) for v in weights):
        raise ValueError("initial weights must be finite")
    return weights


class NetworkParams(
    HasFeaturesCol,
    HasLabelCol,
    HasPredictionCol,
    HasSeed,
    HasMaxIter,
    HasTol,
    HasStepSize,
    HasBlockSize,
):
    """Everything the network estimators can be told."""

    layers = Param(
        Params._dummy(),
        "layers",
        "layer sizes from input to output, at least two, all positive",
        _checked(
            TypeConverters.toListInt,
            lambda v: len(v) > 1 and all(s > 0 for s in v),
            "layers must hold at least two positive sizes",
        ),
    )
    blockSize = Param(
        Params._dummy(),
        "blockSize",
        "rows packed into one training block; 10 to 1000 is a good range",
        _checked(TypeConverters.toInt, lambda v: v > 0, "blockSize must be positive"),
    )
    solver = Param(
        Params._dummy(),
        "solver",
        f"training algorithm: {' or '.join(SOLVERS)}",
        _checked(TypeConverters.toString, lambda v: v in SOLVERS, f"solver must be one of {', '.join(SOLVERS)}"),
    )
    initialWeights = Param(Params._dummy(), "initialWeights", "weights to start from instead of the seed", _weight_list)
    miniBatchFraction = Param(
        Params._dummy(),
        "miniBatchFraction",
        "share of the blocks sampled at each step of solver gd",
        _checked(TypeConverters.toFloat, lambda v: 0 < v <= 1, "miniBatchFraction must be in (0, 1]"),
    )
    averaging = Param(
        Params._dummy(),
        "averaging",
        "what weighs alike in the mean: rows or blocks",
        _checked(TypeConverters.toString, lambda v: v in ("rows", "blocks"), "averaging must be rows or blocks"),
    )
    numPartitions = Param(
        Params._dummy(),
        "numPartitions",
        "reshuffle the training rows into this many partitions first; 0 leaves them where they are",
        _checked(TypeConverters.toInt, lambda v: v >= 0, "numPartitions must not be negative"),
    )
    durableBlocks = Param(
        Params._dummy(),
        "durableBlocks",
        "write training blocks to spark.checkpoint.dir before the loop",
        TypeConverters.toBoolean,
    )

    corrections = Param(
        Params._dummy(),
        "corrections",
        "pairs of steps and gradient changes that l-bfgs keeps",
        _checked(TypeConverters.toInt, lambda v: v > 0, "corrections must be positive"),
    )
    regParam = Param(
        Params._dummy(),
        "regParam",
        "strength of the regulariser that the updater stands for",
        _checked(TypeConverters.toFloat, lambda v: v >= 0, "regParam must not be negative"),
    )
    keyCol = Param(
        Params._dummy(),
        "keyCol",
        "column that decides which rows a minibatch has, on any layout; empty draws blocks partition by partition",
        TypeConverters.toString,
    )
    sparseBlocks = Param(
        Params._dummy(), "sparseBlocks", "keep only the entries of sparse feature vectors while training", TypeConverters.toBoolean
    )
    restartFolder = Param(
        Params._dummy(),
        "restartFolder",
        "folder in which l-bfgs keeps its state and from which a cut run goes on; empty for none",
        TypeConverters.toString,
    )

    #: What no file can hold: set by ``setUpdater``, ``setOnIteration`` and ``setOptimizer``, kept by copies, not saved
    _updater: Updater | None = None
    _on_iteration: Progress | None = None
    _optimizer: Optimizer | None = None

    def __init__(self, *args: Any) -> None:
        super().__init__(*args)
        self._setDefault(
            corrections=10,
            regParam=0.0,
            keyCol="",
            sparseBlocks=False,
            restartFolder="",
            seed=DEFAULT_SEED,
            maxIter=100,
            tol=SMALLEST_TOL,
            stepSize=0.03,
            blockSize=128,
            solver="l-bfgs",
            miniBatchFraction=1.0,
            averaging="rows",
            numPartitions=0,
            durableBlocks=False,
        )

    def getSolver(self) -> str:
        return self.getOrDefault(self.solver)

    def getLayers(self) -> list[int]:
        return self.getOrDefault(self.layers)

    def getInitialWeights(self) -> DenseVector:
        return Vectors.dense(self.getOrDefault(self.initialWeights))

    def getMiniBatchFraction(self) -> float:
        return self.getOrDefault(self.miniBatchFraction)

    def getAveraging(self) -> str:
        return self.getOrDefault(self.averaging)

    def _training_options(self) -> dict[str, Any]:
        """The parameters as keyword arguments of ``fit_network``."""
        return {
            "features": self.getFeaturesCol(),
            "label": self.getLabelCol(),
            "block_size": self.getBlockSize(),
            "solver": self._optimizer or self.getSolver(),
            "max_iter": self.getMaxIter(),
            "tol": self.getTol(),
            "step_size": self.getStepSize(),
            "fraction": self.getMiniBatchFraction(),
            "seed": self.getSeed(),
            "initial_weights": self.getOrDefault(self.initialWeights) if self.isDefined(self.initialWeights) else None,
            "averaging": self.getAveraging(),
            "partitions": self.getOrDefault(self.numPartitions) or None,
            "durable": self.getOrDefault(self.durableBlocks),
            "corrections": self.getOrDefault(self.corrections),
            "reg": self.getOrDefault(self.regParam),
            "key": self.getOrDefault(self.keyCol) or None,
            "sparse": self.getOrDefault(self.sparseBlocks),
            "restart": self.getOrDefault(self.restartFolder) or None,
            "on_iteration": self._on_iteration,
            **({"updater": self._updater} if self._updater is not None else {}),
        }


class NetworkSetters:
    """Fluent setters of the estimators."""

    def setUpdater(self, value: Updater | None):
        """How a gradient and the regulariser move the weights, for solver gd; for l-bfgs, which regulariser."""
        self._updater = value
        return self

    def setOnIteration(self, value: Progress | None):
        """A function told of every iteration: its number, its loss and its weights."""
        self._on_iteration = value
        return self

    def setOptimizer(self, value: Optimizer | None):
        """An optimizer of one's own in place of ``solver``; it brings its own settings."""
        self._optimizer = value
        return self

    def setCorrections(self, value: int):
        return self._set(corrections=value)

    def setRegParam(self, value: float):
        return self._set(regParam=value)

    def setKeyCol(self, value: str):
        return self._set(keyCol=value)

    def setSparseBlocks(self, value: bool):
        return self._set(sparseBlocks=value)

    def setRestartFolder(self, value: str):
        return self._set(restartFolder=value)

    def setLayers(self, value: Sequence[int]):
        return self._set(layers=value)

    def setBlockSize(self, value: int):
        return self._set(blockSize=value)

    def setSolver(self, value: str):
        return self._set(solver=value)

    def setMaxIter(self, value: int):
        return self._set(maxIter=value)

    def setTol(self, value: float):
        return self._set(tol=value)

    def setSeed(self, value: int):
        return self._set(seed=value)

    def setStepSize(self, value: float):
        return self._set(stepSize=value)

    def setInitialWeights(self, value: Any):
        return self._set(initialWeights=value)

    def setMiniBatchFraction(self, value: float):
        return self._set(miniBatchFraction=value)

    def setAveraging(self, value: str):
        return self._set(averaging=value)

    def setNumPartitions(self, value: int):
        return self._set(numPartitions=value)

    def setDurableBlocks(self, value: bool):
        return self._set(durableBlocks=value)

    def setFeaturesCol(self, value: str):
        return self._set(featuresCol=value)

    def setLabelCol(self, value: str):
        return self._set(labelCol=value)

    def setPredictionCol(self, value: str):
        return self._set(predictionCol=value)


class NetworkModel(HasFeaturesCol, HasLabelCol, HasPredictionCol, MLWritable, MLReadable):
    """State and persistence shared by the fitted models: layer sizes and flat weights."""

    def _init_network(self, layers: Sequence[int], weights: Any, history: Sequence[float] | None) -> None:
        self._layers = [int(v) for v in layers]
        self._weights = self.topology.check(weights)
        self._history = None if history is None else list(history)

    @property
    def topology(self) -> Topology:
        raise NotImplementedError

    @property
    def layers(self) -> list[int]:
        return list(self._layers)

    @property
    def weights(self) -> DenseVector:
        return Vectors.dense(self._weights)

    @property
    def numFeatures(self) -> int:
        return self._layers[0]

    @property
    def hasSummary(self) -> bool:
        return self._history is not None

    @property
    def summary(self) -> DataFrame:
        """Loss by iteration, from the initial weights on; only on a model fresh from training."""
        if self._history is None:
            raise RuntimeError("a loaded model has no training summary")
        return history_frame(SparkSession.active(), self._history)

    def weightTable(self) -> DataFrame:
        """The weights as ``(layer, input, output, value)``."""
        return weight_frame(SparkSession.active(), self.topology, self._weights)

    def setFeaturesCol(self, value: str):
        return self._set(featuresCol=value)

    def setPredictionCol(self, value: str):
        return self._set(predictionCol=value)

    def write(self) -> MLWriter:
        return NetworkModelWriter(self)

    @classmethod
    def read(cls) -> "NetworkModelReader":
        return NetworkModelReader(cls)


class NetworkModelWriter(MLWriter):
    """Metadata as JSON, and one parquet row with layer sizes and weights."""

    def __init__(self, instance: NetworkModel) -> None:
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        spark = self.sparkSession
        DefaultParamsWriter.saveMetadata(self.instance, path, spark)
        row = (self.instance.layers, self.instance.weights)
        data = spark.createDataFrame([row], ["layers", "weights"])
        data.selectExpr("cast(layers as array<int>) layers", "weights").coalesce(1).write.parquet(os.path.join(path, "data"))


class NetworkModelReader(MLReader):
    """Loads what ``NetworkModelWriter`` wrote, checking the class it was written from."""

    def __init__(self, cls: type) -> None:
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        spark = self.sparkSession
        expected = f"{self.cls.__module__}.{self.cls.__name__}"
        metadata = DefaultParamsReader.loadMetadata(path, spark, expected)
        row = spark.read.parquet(os.path.join(path, "data")).select("layers", "weights").head()
        model = self.cls(row["layers"], row["weights"])
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


def finish_fit(model: NetworkModel, estimator: Params, fit: Fit) -> NetworkModel:
    """Carry the estimator's columns and identity over to its model."""
    model._resetUid(estimator.uid)
    model._history = fit.history
    return estimator._copyValues(model)


def as_weights(values: Any) -> np.ndarray:
    return np.asarray(values, dtype=np.float64)
