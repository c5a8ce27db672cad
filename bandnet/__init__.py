"""Dense neural networks over Spark tables of feature vectors."""

import sys

from pyspark import cloudpickle

# Executors get the small functions they run together with each job, so that nothing has to be
# installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from bandnet.models import DenseAutoencoder, DenseAutoencoderModel, DenseClassifier, DenseClassifierModel
from bandnet.operators import ReconstructionEvaluator, Topology, fit_network
from bandnet.plans import run_autoencoder, run_classification

__all__ = [
    "DenseAutoencoder",
    "DenseAutoencoderModel",
    "DenseClassifier",
    "DenseClassifierModel",
    "ReconstructionEvaluator",
    "Topology",
    "fit_network",
    "run_autoencoder",
    "run_classification",
]
