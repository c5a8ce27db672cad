"""Queries for trained networks: estimators, persistence, evaluation and the end-to-end jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from bandnet.catalog import sql as S
from bandnet.catalog.network import (
    AUTOENCODER, CLASSIFIER, SIGMOID_SIZES, _CLASSIFY, _PREDICTED, _RECONSTRUCT, sigmoid_network, weights_of,
)
from bandnet.catalog.registry import query
from bandnet.catalog.tables import rounded, vectors
from bandnet.models import DenseAutoencoder, DenseAutoencoderModel, DenseClassifier, DenseClassifierModel
from bandnet.functions.counter import PRIME, sample_limit
from bandnet.operators import (
    Topology, fit_network, fold_mse, k_folds, mean_fold_mse, random_weight_frame, reconstruction_mse, weight_frame,
)
from bandnet.plans import run_autoencoder, run_classification
from bandnet.sources import scratch_path


def _formula(sizes, kind="classifier"):
    return weights_of(getattr(Topology, kind)(sizes))


def _formula_autoencoder() -> DenseAutoencoderModel:
    return DenseAutoencoderModel(AUTOENCODER, _formula(AUTOENCODER, "autoencoder"))


NETWORK_STEP, TARGET_STEP = 0.5, 0.01


def _network_steps_sql() -> str:
    ctes = [S.EMBEDDING_ROWS, S.LABEL_ROWS, *S.weight_ctes(CLASSIFIER, "_0")]
    for t in range(2):
        tag, after = f"_{t}", f"_{t + 1}"
        ctes += [*S.forward_ctes(CLASSIFIER, tag), S.error_cte(CLASSIFIER, tag), *S.gradient_ctes(CLASSIFIER, tag)]
        ctes += S.step_ctes(CLASSIFIER, tag, after, NETWORK_STEP)
    return S.with_(ctes, S.layered_select(CLASSIFIER, "w", "b", "value", tag="_2"))


@query("gd_network_steps", _network_steps_sql())
def _gd_network_steps(spark, folder):
    estimator = DenseClassifier(
        layers=CLASSIFIER, solver="gd", maxIter=2, stepSize=NETWORK_STEP, tol=0.0, initialWeights=_formula(CLASSIFIER)
    )
    weights = estimator.fit(vectors(spark, folder)).weightTable()
    return weights.select("layer", "input", "output", rounded("value", 9).alias("value"))


def _target_steps_sql(sizes, hidden: str, top: str) -> str:
    ctes = [S.EMBEDDING_ROWS, S.REVERSED_ROWS, *S.weight_ctes(sizes, "_0")]
    for t in range(2):
        tag, after = f"_{t}", f"_{t + 1}"
        ctes += [*S.forward_ctes(sizes, tag, hidden, top), S.error_cte(sizes, tag, "column")]
        ctes += [*S.gradient_ctes(sizes, tag, hidden, top), *S.step_ctes(sizes, tag, after, TARGET_STEP)]
    return S.with_(ctes, S.layered_select(sizes, "w", "b", "value", tag="_2"))


def _target_steps(spark, folder, topology):
    """Two steps towards the first values of the reversed features, as many as there are outputs."""
    rows = vectors(spark, folder).withColumn("aim", F.slice(F.reverse("features"), 1, topology.outputs))
    fit = fit_network(
        rows, topology, target="aim", solver="gd", max_iter=2, step_size=TARGET_STEP, tol=0.0, initial_weights=weights_of(topology)
    )
    return weight_frame(spark, topology, fit.weights).select("layer", "input", "output", rounded("value", 9).alias("value"))


@query("gd_target_steps", _target_steps_sql(AUTOENCODER, "relu", "identity"))
def _gd_target_steps(spark, folder):
    return _target_steps(spark, folder, Topology.regressor(AUTOENCODER))


@query("gd_sigmoid_target_steps", _target_steps_sql(SIGMOID_SIZES, "sigmoid", "sigmoid"))
def _gd_sigmoid_target_steps(spark, folder):
    return _target_steps(spark, folder, Topology(sigmoid_network().layers, "column"))


MINIBATCH_SEED, MINIBATCH_STEPS, MINIBATCH_STEP, MINIBATCH_SHARE = 42, 3, 0.5, 0.3


def _minibatch_sql() -> str:
    """Unrolled steps, each over the rows whose number in the generator of its seed is small enough."""
    ctes = [S.EMBEDDING_ROWS, S.LABEL_ROWS, *S.weight_ctes(CLASSIFIER, "_0")]
    ctes.append(f"counted AS MATERIALIZED (SELECT vec_id AS id, {S.row_counter('vec_id')} AS c FROM embeddings)")
    for t in range(MINIBATCH_STEPS):
        tag, after = f"_{t}", f"_{t + 1}"
        drawn = S.permuted("c", MINIBATCH_SEED + t + 1, "counted", "id")
        ctes.append(f"pick{tag} AS MATERIALIZED (SELECT id FROM ({drawn}) WHERE p < {sample_limit(MINIBATCH_SHARE)})")
        error = S.error_cte(CLASSIFIER, tag).removesuffix(")") + f" JOIN pick{tag} k ON a.id = k.id)"
        ctes += [*S.forward_ctes(CLASSIFIER, tag), error]
        ctes += S.gradient_ctes(CLASSIFIER, tag, rows=f"(SELECT count(*) FROM pick{tag})")
        ctes += S.step_ctes(CLASSIFIER, tag, after, MINIBATCH_STEP)
    return S.with_(ctes, S.layered_select(CLASSIFIER, "w", "b", "value", tag=f"_{MINIBATCH_STEPS}"))


@query("gd_minibatch", _minibatch_sql())
def _gd_minibatch(spark, folder):
    estimator = DenseClassifier(
        layers=CLASSIFIER, solver="gd", maxIter=MINIBATCH_STEPS, stepSize=MINIBATCH_STEP, blockSize=16, tol=0.0,
        miniBatchFraction=MINIBATCH_SHARE, keyCol="id", initialWeights=_formula(CLASSIFIER),
    )
    weights = estimator.fit(vectors(spark, folder)).weightTable()
    return weights.select("layer", "input", "output", rounded("value", 9).alias("value"))


RANDOM_SEED = 2024


def _random_weights_sql(scale: str) -> str:
    """Weights of the classifier's layers from their positions; ``scale`` is what the features multiply them by."""
    parts, at = [], 0
    for number, (inputs, outputs) in enumerate(zip(CLASSIFIER, CLASSIFIER[1:])):
        cells = inputs * outputs
        drawn = S.permuted(f"i + {at}", RANDOM_SEED, f"range({cells + outputs}) t(i)", "i")
        parts.append(
            f"SELECT {number}::int AS layer, (CASE WHEN i < {cells} THEN i // {outputs} ELSE -1 END)::int AS input, (i % {outputs})::int AS output, "
            f"((p + 0.5::double) / {PRIME} * 4.8 - 2.4) / sqrt({inputs}::double) AS value FROM ({drawn})"
        )
        at += cells + outputs
    drawn = "\nUNION ALL ".join(parts)
    return (
        f"WITH w AS ({drawn}), spread AS (SELECT generate_subscripts(embedding, 1) - 1 AS input, unnest(embedding)::double AS v FROM embeddings), "
        f"mean AS (SELECT input, avg(v) AS m FROM spread GROUP BY input) "
        f"SELECT layer, w.input, output, {S.r('value', 12)} AS value, {S.r(scale, 9)} AS mean_input FROM w LEFT JOIN mean ON layer = 0 AND w.input = mean.input"
    )


@query("random_weights", _random_weights_sql("coalesce(value * m, 0)"))
def _random_weights(spark, folder):
    """Initial weights made by Spark, and what the mean of the data adds to the first layer through each."""
    topology = Topology.classifier(CLASSIFIER)
    spread = vectors(spark, folder).select(F.posexplode("features").alias("input", "v"))
    mean = spread.groupBy("input").agg(F.avg(F.col("v").cast("double")).alias("m")).withColumn("layer", F.lit(0))
    weights = random_weight_frame(spark, topology, RANDOM_SEED).join(mean, ["layer", "input"], "left")
    adds = F.coalesce(F.col("value") * F.col("m"), F.lit(0.0))
    return weights.select("layer", "input", "output", rounded("value", 12).alias("value"), rounded(adds, 9).alias("mean_input"))


def _first_loss(model):
    return model.summary.where("iteration = 0").select("iteration", rounded("loss", 9).alias("loss"))


@query(
    "lbfgs_classifier_first_loss",
    S.with_(
        _CLASSIFY,
        f"SELECT 0::bigint AS iteration, {S.r('-sum(logp) / count(*)', 9)} AS loss FROM a2 JOIN y ON a2.id = y.id AND a2.f = y.label",
    ),
)
def _lbfgs_classifier_first_loss(spark, folder):
    estimator = DenseClassifier(layers=CLASSIFIER, maxIter=3, initialWeights=_formula(CLASSIFIER))
    return _first_loss(estimator.fit(vectors(spark, folder)))


@query(
    "lbfgs_autoencoder_first_loss",
    S.with_(
        _RECONSTRUCT,
        f"SELECT 0::bigint AS iteration, {S.r('sum((a.v - x.v) * (a.v - x.v)) / (2 * count(*))', 9)} AS loss "
        "FROM a2 a JOIN x ON a.id = x.id AND a.f = x.f",
    ),
)
def _lbfgs_autoencoder_first_loss(spark, folder):
    estimator = DenseAutoencoder(layers=AUTOENCODER, maxIter=3, initialWeights=_formula(AUTOENCODER, "autoencoder"))
    return _first_loss(estimator.fit(vectors(spark, folder)))


@query("lbfgs_linear_autoencoder", S.with_([S.EMBEDDING_ROWS], f"SELECT id, f::int AS band, {S.r('v', 3)} AS value FROM x"))
def _lbfgs_linear_autoencoder(spark, folder):
    # without a hidden layer the best autoencoder is the identity, so training must return the input
    df = vectors(spark, folder)
    model = DenseAutoencoder(layers=[64, 64], maxIter=100, tol=1e-12, initialWeights=_formula([64, 64], "autoencoder")).fit(df)
    output = model.transform(df).select("id", F.posexplode("prediction").alias("band", "value"))
    return output.select("id", "band", rounded("value", 3).alias("value"))


@query("lbfgs_classifier_curve")
def _lbfgs_classifier_curve(spark, folder):
    estimator = DenseClassifier(layers=CLASSIFIER, maxIter=10, initialWeights=_formula(CLASSIFIER))
    return estimator.fit(vectors(spark, folder)).summary


@query("lbfgs_autoencoder_curve")
def _lbfgs_autoencoder_curve(spark, folder):
    estimator = DenseAutoencoder(layers=AUTOENCODER, maxIter=10, initialWeights=_formula(AUTOENCODER, "autoencoder"))
    return estimator.fit(vectors(spark, folder)).summary


@query("save_load_predict", S.with_([*_CLASSIFY, _PREDICTED], f"SELECT id, prediction, {S.r('top')} AS top FROM best"))
def _save_load_predict(spark, folder):
    path = scratch_path(spark, "model")
    DenseClassifierModel(CLASSIFIER, _formula(CLASSIFIER)).save(path)
    scored = DenseClassifierModel.load(path).transform(vectors(spark, folder))
    return scored.select("id", "prediction", rounded(F.array_max("probability")).alias("top"))


_SQUARES = "sum((a.v - x.v) * (a.v - x.v)) / count(*)"
_PAIRS = "FROM a2 a JOIN x ON a.id = x.id AND a.f = x.f"


@query("recon_mse", S.with_(_RECONSTRUCT, f"SELECT {S.r(_SQUARES, 9)} AS mse {_PAIRS}"))
def _recon_mse(spark, folder):
    scored = _formula_autoencoder().transform(vectors(spark, folder))
    return reconstruction_mse(scored).select(rounded("mse", 9).alias("mse"))


_FOLD = "(('0x' || substr(md5('fold:' || a.id::varchar), 1, 15))::bigint % 4)::int"


@query(
    "fold_mse",
    S.with_(_RECONSTRUCT, f"SELECT {_FOLD} AS fold, {S.r(_SQUARES, 9)} AS mse, (count(*) // 64)::bigint AS n {_PAIRS} GROUP BY 1"),
)
def _fold_mse(spark, folder):
    scored = _formula_autoencoder().transform(k_folds(vectors(spark, folder), "id", 4))
    return fold_mse(scored).select("fold", rounded("mse", 9).alias("mse"), "n")


@query(
    "mean_fold_mse",
    S.with_(
        [*_RECONSTRUCT, f"folds AS (SELECT {_FOLD} AS fold, {_SQUARES} AS mse {_PAIRS} GROUP BY 1)"],
        f"SELECT {S.r('avg(mse)', 9)} AS mse FROM folds",
    ),
)
def _mean_fold_mse(spark, folder):
    scored = _formula_autoencoder().transform(k_folds(vectors(spark, folder), "id", 4))
    return mean_fold_mse(scored).select(rounded("mse", 9).alias("mse"))


@query("run_classification")
def _run_classification(spark, folder):
    result = run_classification(spark, vectors(spark, folder), 0.8, 30, layers=[64, 32, 10], key="id")
    return result.metrics


@query("run_autoencoder")
def _run_autoencoder(spark, folder):
    result = run_autoencoder(spark, vectors(spark, folder), 0.8, 30, layers=[64, 32, 64], key="id")
    return result.metrics
