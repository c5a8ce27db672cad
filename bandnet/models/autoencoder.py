"""A ReLU autoencoder in ``pyspark.ml`` style."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.linalg import DenseVector, Vector, Vectors
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame

from bandnet.models.params import NetworkModel, NetworkParams, NetworkSetters, as_weights, finish_fit
from bandnet.operators.losses import forward_outputs
from bandnet.operators.optimizers import Fit
from bandnet.operators.scoring import encode, network_column
from bandnet.operators.topology import Topology
from bandnet.operators.training import fit_network


class DenseAutoencoder(Estimator, NetworkParams, NetworkSetters, DefaultParamsWritable, DefaultParamsReadable):
    """Trains a network whose output should equal its input; it needs no label column."""

    @keyword_only
    def __init__(self, **kwargs: Any) -> None:
        super().__init__()
        self._set(**self._input_kwargs)

    @keyword_only
    def setParams(self, **kwargs: Any) -> "DenseAutoencoder":
        return self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "DenseAutoencoderModel":
        return self._fitted(fit_network(dataset, Topology.autoencoder(self.getLayers()), **self._training_options()))

    def _fitted(self, fit: Fit) -> "DenseAutoencoderModel":
        return finish_fit(DenseAutoencoderModel(self.getLayers(), fit.weights), self, fit)

    def fit_part(self, dataset: DataFrame, part: str, scaling: str | None = None) -> tuple["DenseAutoencoderModel", Fit]:
        """Fit on the rows where the boolean column ``part`` is true, reading the table once.

        ``scaling`` maps the features to [0, 1] first, by the bounds of "all" rows or of the "train" ones; the bounds are
        in the ``Fit``, and rows to be scored have to be mapped by them.
        """
        fit = fit_network(dataset, Topology.autoencoder(self.getLayers()), part=part, scaling=scaling, **self._training_options())
        return self._fitted(fit), fit


class DenseAutoencoderModel(Model, NetworkModel):
    """A fitted autoencoder: ``transform`` appends the reconstruction as ``array<double>``."""

    def __init__(self, layers: Sequence[int], weights: Any, history: Sequence[float] | None = None) -> None:
        super().__init__()
        self._init_network(layers, weights, history)

    @property
    def topology(self) -> Topology:
        return Topology.autoencoder(self._layers)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.reconstruct(dataset)

    def reconstruct(self, dataset: DataFrame) -> DataFrame:
        """Append the network's output."""
        output = network_column(dataset, self.topology, self._weights, self.getFeaturesCol())
        return dataset.withColumn(self.getPredictionCol(), output)

    def encode(self, dataset: DataFrame, output: str = "code") -> DataFrame:
        """Append the code of the narrowest hidden layer."""
        return encode(dataset, self.topology, self._weights, self.getFeaturesCol(), output)

    def predict(self, features: Vector | Sequence[float]) -> DenseVector:
        """The reconstruction of one feature vector."""
        x = as_weights(features.toArray() if hasattr(features, "toArray") else features)[None, :]
        return Vectors.dense(forward_outputs(self.topology, self._weights, x)[-1][0])
