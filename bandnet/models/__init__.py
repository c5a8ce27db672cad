"""Estimators and fitted models."""

from bandnet.models.autoencoder import DenseAutoencoder, DenseAutoencoderModel
from bandnet.models.classifier import DenseClassifier, DenseClassifierModel

__all__ = ["DenseAutoencoder", "DenseAutoencoderModel", "DenseClassifier", "DenseClassifierModel"]
