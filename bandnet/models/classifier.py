"""A ReLU/softmax network classifier in ``pyspark.ml`` style."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.linalg import Vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame

from bandnet.functions import argmax
from bandnet.models.params import NetworkModel, NetworkParams, NetworkSetters, as_weights, finish_fit
from bandnet.operators.losses import forward_outputs
from bandnet.operators.optimizers import Fit
from bandnet.operators.scoring import network_column
from bandnet.operators.topology import Topology
from bandnet.operators.training import fit_network


class HasOptionalProbability(Params):
    """Name of the class-probability column; empty for none."""

    probabilityCol = Param(
        Params._dummy(), "probabilityCol", "class probabilities, as array<double>; empty for none", TypeConverters.toString
    )

    def __init__(self, *args: Any) -> None:
        super().__init__(*args)
        self._setDefault(probabilityCol="probability")

    def setProbabilityCol(self, value: str):
        return self._set(probabilityCol=value)

    def getProbabilityCol(self) -> str:
        return self.getOrDefault(self.probabilityCol)


class DenseClassifier(
    Estimator, NetworkParams, HasOptionalProbability, NetworkSetters, DefaultParamsWritable, DefaultParamsReadable
):
    """Trains a classifier whose hidden layers are ReLU and whose output is softmax.

    The first layer size is the number of features, the last the number of classes; labels are
    0 to classes - 1.
    """

    @keyword_only
    def __init__(self, **kwargs: Any) -> None:
        super().__init__()
        self._set(**self._input_kwargs)

    @keyword_only
    def setParams(self, **kwargs: Any) -> "DenseClassifier":
        return self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "DenseClassifierModel":
        return self._fitted(fit_network(dataset, Topology.classifier(self.getLayers()), **self._training_options()))

    def _fitted(self, fit: Fit) -> "DenseClassifierModel":
        return finish_fit(DenseClassifierModel(self.getLayers(), fit.weights), self, fit)

    def fit_part(self, dataset: DataFrame, part: str, scaling: str | None = None) -> tuple["DenseClassifierModel", Fit]:
        """Fit on the rows where the boolean column ``part`` is true, reading the table once.

        ``scaling`` maps the features to [0, 1] first, by the bounds of "all" rows or of the "train" ones; the bounds are
        in the ``Fit``, and rows to be scored have to be mapped by them.
        """
        fit = fit_network(dataset, Topology.classifier(self.getLayers()), part=part, scaling=scaling, **self._training_options())
        return self._fitted(fit), fit


class DenseClassifierModel(Model, NetworkModel, HasOptionalProbability):
    """A fitted classifier."""

    def __init__(self, layers: Sequence[int], weights: Any, history: Sequence[float] | None = None) -> None:
        super().__init__()
        self._init_network(layers, weights, history)

    @property
    def topology(self) -> Topology:
        return Topology.classifier(self._layers)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if not self.getProbabilityCol():
            label = network_column(dataset, self.topology, self._weights, self.getFeaturesCol(), decode=True)
            return dataset.withColumn(self.getPredictionCol(), label)
        chances = network_column(dataset, self.topology, self._weights, self.getFeaturesCol())
        scored = dataset.withColumn(self.getProbabilityCol(), chances)
        return scored.withColumn(self.getPredictionCol(), argmax(self.getProbabilityCol()))

    def predict(self, features: Vector | Sequence[float]) -> float:
        """The label of one feature vector."""
        x = as_weights(features.toArray() if hasattr(features, "toArray") else features)[None, :]
        return float(forward_outputs(self.topology, self._weights, x)[-1][0].argmax())
