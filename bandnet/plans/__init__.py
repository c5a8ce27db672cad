"""End-to-end jobs."""

from bandnet.plans.applications import (
    AUTOENCODER_LAYERS,
    CLASSIFIER_LAYERS,
    ApplicationResult,
    prepare,
    run_autoencoder,
    run_classification,
    train_test,
)

__all__ = [
    "AUTOENCODER_LAYERS",
    "CLASSIFIER_LAYERS",
    "ApplicationResult",
    "prepare",
    "run_autoencoder",
    "run_classification",
    "train_test",
]
