"""Operators over tables: preparation, blocks, objectives, training, scoring, evaluation."""

from bandnet.operators.blocks import check_labels, labeled_rows, stack_blocks, staged_blocks, unstack_blocks
from bandnet.operators.evaluation import (
    ReconstructionEvaluator,
    accuracy,
    accuracy_by_label,
    fold_mse,
    mean_fold_mse,
    reconstruction_mse,
)
from bandnet.operators.losses import HingeLoss, LeastSquaresLoss, LinearLoss, LogisticLoss, MultinomialLoss, NetworkLoss
from bandnet.operators.nnls import gram_matrix, nnls_by_group, nnls_fit, solve_nonnegative, unmix
from bandnet.operators.objective import BlockObjective, ColumnObjective, Evaluation, gradient_frame, linear_sums, loss_frame, partial_sums, sparse_linear_sums
from bandnet.operators.optimizers import Fit, GradientDescent, Lbfgs, LbfgsState, Optimizer, minimize_gd, minimize_lbfgs
from bandnet.operators.restart import StateFolder, state_frame, state_from_frame
from bandnet.operators.scaling import Bounds, minmax_columns, minmax_fit, minmax_scale, minmax_stats
from bandnet.operators.scoring import encode, forward, forward_all, network_column
from bandnet.operators.sparse import SparseRows, affine
from bandnet.operators.splits import k_folds, random_split, split_bounds, split_by_key, split_rows
from bandnet.operators.topology import (
    RELU,
    SIGMOID,
    Activation,
    Affine,
    Elementwise,
    SigmoidSquaredError,
    SoftmaxCrossEntropy,
    SquaredError,
    Topology,
)
from bandnet.operators.training import fit_network, formula_weights, history_frame, random_weight_frame, weight_frame
from bandnet.operators.updaters import constant_step, l1_step, l2_step, penalty, simple_step

__all__ = [
    "Activation",
    "Affine",
    "BlockObjective",
    "Bounds",
    "ColumnObjective",
    "Elementwise",
    "Evaluation",
    "Fit",
    "GradientDescent",
    "HingeLoss",
    "Lbfgs",
    "LbfgsState",
    "LeastSquaresLoss",
    "LinearLoss",
    "LogisticLoss",
    "MultinomialLoss",
    "NetworkLoss",
    "Optimizer",
    "RELU",
    "ReconstructionEvaluator",
    "SIGMOID",
    "SigmoidSquaredError",
    "SoftmaxCrossEntropy",
    "SparseRows",
    "SquaredError",
    "StateFolder",
    "Topology",
    "accuracy",
    "accuracy_by_label",
    "affine",
    "check_labels",
    "constant_step",
    "encode",
    "fit_network",
    "fold_mse",
    "formula_weights",
    "forward",
    "forward_all",
    "gradient_frame",
    "gram_matrix",
    "history_frame",
    "k_folds",
    "l1_step",
    "l2_step",
    "labeled_rows",
    "linear_sums",
    "loss_frame",
    "mean_fold_mse",
    "minimize_gd",
    "minimize_lbfgs",
    "minmax_columns",
    "minmax_fit",
    "minmax_scale",
    "minmax_stats",
    "network_column",
    "nnls_by_group",
    "nnls_fit",
    "partial_sums",
    "penalty",
    "random_split",
    "random_weight_frame",
    "reconstruction_mse",
    "simple_step",
    "solve_nonnegative",
    "sparse_linear_sums",
    "split_bounds",
    "split_by_key",
    "split_rows",
    "stack_blocks",
    "staged_blocks",
    "state_frame",
    "state_from_frame",
    "unmix",
    "unstack_blocks",
    "weight_frame",
]
