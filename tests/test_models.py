import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import MinMaxScaler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from bandnet import DenseAutoencoder, DenseAutoencoderModel, DenseClassifier, DenseClassifierModel, ReconstructionEvaluator
from bandnet.operators import (
    LogisticLoss,
    NetworkLoss,
    Topology,
    accuracy,
    accuracy_by_label,
    fit_network,
    fold_mse,
    formula_weights,
    l2_step,
    mean_fold_mse,
    reconstruction_mse,
)
from bandnet.plans import run_autoencoder, run_classification
from bandnet.sources import scratch_path


@pytest.fixture(scope="module")
def clouds(spark):
    """Three well separated groups of points."""
    gen = np.random.default_rng(0)
    centers = np.array([[0, 0, 3, 0], [3, 0, 0, 0], [0, 3, 0, 3]])
    y = np.arange(150) % 3
    x = centers[y] + gen.normal(size=(150, 4)) * 0.4
    rows = [(i, [float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, features array<double>, label double").repartition(3).cache()


def test_classifier_learns(clouds):
    model = DenseClassifier(layers=[4, 5, 3], maxIter=40, seed=3).fit(clouds)
    scored = model.transform(clouds)
    assert accuracy(scored).first().accuracy > 0.97
    losses = [r.loss for r in model.summary.orderBy("iteration").collect()]
    assert losses == sorted(losses, reverse=True) and losses[-1] < 0.2 * losses[0]
    assert model.numFeatures == 4 and model.layers == [4, 5, 3] and len(model.weights) == 43
    row = scored.first()
    assert model.predict(row.features) == row.prediction == model.predict(Vectors.dense(row.features))
    assert abs(sum(row.probability) - 1) < 1e-12
    plain = model.setProbabilityCol("").transform(clouds)
    assert "probability" not in plain.columns
    assert [r.prediction for r in plain.orderBy("id").collect()] == [r.prediction for r in scored.orderBy("id").collect()]


def test_autoencoder_learns_without_labels(clouds):
    df = clouds.select("id", "features")
    model = DenseAutoencoder(layers=[4, 4, 4], maxIter=60, seed=5).fit(df)
    before = DenseAutoencoderModel([4, 4, 4], Topology.autoencoder([4, 4, 4]).random_weights(5)).transform(df)
    after = model.transform(df)
    assert ReconstructionEvaluator().evaluate(after) < 0.5 * ReconstructionEvaluator().evaluate(before)
    assert not ReconstructionEvaluator().isLargerBetter()
    losses = [r.loss for r in model.summary.orderBy("iteration").collect()]
    # the reported loss is half the mean squared error over all values
    assert losses[-1] == pytest.approx(ReconstructionEvaluator().evaluate(after) / 2, rel=1e-9)
    row = after.first()
    np.testing.assert_allclose(model.predict(row.features).toArray(), row.prediction)
    assert len(model.encode(df).first().code) == 4


def test_vectors_and_pipelines(spark, clouds):
    df = clouds.select("label", array_to_vector("features").alias("raw"))
    stages = [MinMaxScaler(inputCol="raw", outputCol="features"), DenseClassifier(layers=[4, 3], maxIter=20)]
    model = Pipeline(stages=stages).fit(df)
    assert accuracy(model.transform(df)).first().accuracy > 0.95
    path = scratch_path(spark, "stages")
    model.write().save(path)
    again = PipelineModel.load(path)
    assert again.stages[1].weights == model.stages[1].weights
    assert accuracy(again.transform(df)).first() == accuracy(model.transform(df)).first()


def test_layout_and_block_size_do_not_matter(clouds):
    weights = formula_weights(43)
    fits = [
        DenseClassifier(layers=[4, 5, 3], maxIter=3, initialWeights=weights, blockSize=b, numPartitions=p).fit(clouds)
        for b, p in ((128, 0), (7, 1), (16, 9))
    ]
    for other in fits[1:]:
        np.testing.assert_allclose(other.weights, fits[0].weights, atol=1e-9)


def test_gradient_descent_solver(clouds):
    start = formula_weights(43)
    fit = DenseClassifier(
        layers=[4, 5, 3], solver="gd", maxIter=2, stepSize=0.3, tol=0.0, initialWeights=start
    ).fit(clouds)
    rows = clouds.collect()
    x, y = np.array([r.features for r in rows]), np.array([r.label for r in rows])
    loss, w = NetworkLoss(Topology.classifier([4, 5, 3])), start.copy()
    for _ in range(2):
        w = w - 0.3 * loss.partial(x, y, w)[1] / len(x)
    np.testing.assert_allclose(fit.weights.toArray(), w, atol=1e-12)


def test_minibatches_sample_blocks(clouds):
    options = dict(layers=[4, 3], solver="gd", maxIter=6, stepSize=0.1, tol=0.0, blockSize=5, miniBatchFraction=0.5, seed=1)
    a, b = DenseClassifier(**options).fit(clouds), DenseClassifier(**options).fit(clouds)
    np.testing.assert_allclose(a.weights, b.weights, atol=1e-12)
    whole = DenseClassifier(**{**options, "miniBatchFraction": 1.0}).fit(clouds)
    assert not np.allclose(a.weights, whole.weights)


def test_durable_blocks(spark, clouds):
    options = dict(layers=[4, 3], maxIter=3, seed=1)
    plain = DenseClassifier(**options).fit(clouds)
    durable = DenseClassifier(durableBlocks=True, **options).fit(clouds)
    np.testing.assert_allclose(plain.weights, durable.weights, atol=1e-12)


def test_no_blocks_stay_cached(spark, clouds):
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    DenseClassifier(layers=[4, 3], maxIter=2).fit(clouds)
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == before
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").startswith("67108864")


def test_parameters():
    est = DenseClassifier()
    assert (est.getMaxIter(), est.getBlockSize(), est.getStepSize(), est.getSolver(), est.getTol()) == (100, 128, 0.03, "l-bfgs", 5e-324)
    est.setLayers([3, 2]).setBlockSize(10).setSolver("gd").setMaxIter(4).setTol(0.1).setSeed(9).setStepSize(0.5)
    est.setInitialWeights(Vectors.dense(range(8))).setAveraging("blocks").setMiniBatchFraction(0.5)
    assert est.getLayers() == [3, 2] and list(est.getInitialWeights()) == list(range(8)) and est.getSeed() == 9
    assert est.setParams(maxIter=7).getMaxIter() == 7
    clone = est.copy({est.maxIter: 11})
    assert clone.getMaxIter() == 11 and est.getMaxIter() == 7 and clone.getLayers() == [3, 2]
    for bad in (
        {"layers": [3]},
        {"layers": [3, 0]},
        {"blockSize": 0},
        {"solver": "newton"},
        {"averaging": "files"},
        {"miniBatchFraction": 0.0},
        {"initialWeights": [float("nan")]},
    ):
        with pytest.raises((ValueError, TypeError)):
            DenseClassifier(**bad)


def test_wrong_input_is_refused(clouds):
    with pytest.raises(ValueError, match="outside 0..1"):
        DenseClassifier(layers=[4, 2]).fit(clouds)
    with pytest.raises(ValueError, match="expected 15 weights"):
        DenseClassifier(layers=[4, 3], initialWeights=[0.0]).fit(clouds)
    with pytest.raises(Exception, match="needs 5 values, found 4"):
        DenseClassifier(layers=[5, 3]).fit(clouds)
    with pytest.raises(ValueError):
        DenseAutoencoder(layers=[4, 3]).fit(clouds)
    with pytest.raises(ValueError, match="solver"):
        fit_network(clouds, Topology.classifier([4, 3]), solver="other")


@pytest.mark.parametrize("solver", ["gd", "l-bfgs"])
def test_empty_table_returns_the_start(clouds, solver):
    start = formula_weights(15)
    fit = fit_network(clouds.limit(0), Topology.classifier([4, 3]), solver=solver, initial_weights=start)
    np.testing.assert_array_equal(fit.weights, start)


def test_swapped_loss_and_updater(clouds):
    two = clouds.where("label < 2")

    class Logistic(LogisticLoss):
        """Uses the same weight vector as a one-output network without its bias."""

        def weight_count(self, width):
            return 15

        def partial(self, x, y, w):
            loss, gradient = super().partial(x, y, w[:4])
            return loss, np.append(gradient, np.zeros(11))

    fit = fit_network(two, Topology.classifier([4, 3]), loss=Logistic(), updater=l2_step, reg=0.01, max_iter=20, seed=2)
    assert fit.history[-1] < fit.history[0]
    np.testing.assert_allclose(fit.weights[4:], 0, atol=1e-4)
    # The loss says how many weights there are
    plain = fit_network(two, Topology.classifier([4, 3]), loss=LogisticLoss(), updater=l2_step, reg=0.01, max_iter=20)
    np.testing.assert_allclose(plain.weights, fit.weights[:4], atol=1e-2)
    with pytest.raises(ValueError, match="expected 4 weights"):
        fit_network(two, Topology.classifier([4, 3]), loss=LogisticLoss(), initial_weights=[0.0] * 15)


def test_saving_and_loading(spark, clouds):
    est = DenseClassifier(layers=[4, 3], maxIter=2, initialWeights=list(range(15)), solver="gd")
    path = scratch_path(spark, "estimator")
    est.save(path)
    back = DenseClassifier.load(path)
    assert back.uid == est.uid and back.getLayers() == [4, 3] and list(back.getInitialWeights()) == list(range(15))
    model = est.fit(clouds)
    path = scratch_path(spark, "model")
    model.setPredictionCol("guess").write().save(path)
    with pytest.raises(Exception):
        model.write().save(path)
    model.write().overwrite().save(path)
    loaded = DenseClassifierModel.load(path)
    assert loaded.uid == est.uid and loaded.layers == [4, 3] and loaded.weights == model.weights
    assert loaded.getPredictionCol() == "guess" and not loaded.hasSummary
    with pytest.raises(RuntimeError):
        loaded.summary
    assert loaded.transform(clouds).first().guess == model.transform(clouds).first().guess
    stored = spark.read.parquet(f"{path}/data")
    assert stored.count() == 1 and dict(stored.dtypes)["layers"] == "array<int>"
    with pytest.raises(Exception):
        DenseAutoencoderModel.load(path)
    auto = DenseAutoencoder(layers=[4, 4], maxIter=1).fit(clouds)
    path = scratch_path(spark, "auto")
    auto.save(path)
    assert DenseAutoencoderModel.load(path).weights == auto.weights


def test_weight_table():
    table = DenseClassifierModel([2, 3], np.arange(9.0)).weightTable().collect()
    got = {(r.layer, r.input, r.output): r.value for r in table}
    assert got[0, 0, 1] == 1.0 and got[0, 1, 0] == 3.0 and got[0, -1, 2] == 8.0


def test_errors_by_fold(spark):
    rows = [(0, [1.0, 2.0], [1.0, 4.0]), (0, [0.0, 0.0], [0.0, 0.0]), (1, [1.0, 1.0], [2.0, 2.0])]
    df = spark.createDataFrame(rows, "fold int, features array<double>, prediction array<double>")
    assert {r.fold: r.mse for r in fold_mse(df).collect()} == {0: 1.0, 1: 1.0}
    assert reconstruction_mse(df).first().mse == 1.0 and mean_fold_mse(df).first().mse == 1.0
    assert reconstruction_mse(df.limit(0)).first().mse is None
    assert np.isnan(ReconstructionEvaluator().evaluate(df.limit(0)))
    labels = spark.createDataFrame([(1.0, 1), (0.0, 1), (2.0, 2)], "prediction double, label int")
    assert {r.label: r.accuracy for r in accuracy_by_label(labels).collect()} == {1: 0.5, 2: 1.0}


@pytest.mark.parametrize("key,fit_on", [("id", "all"), (None, "train")])
def test_whole_jobs(spark, clouds, key, fit_on):
    found = run_classification(spark, clouds, 0.7, 20, [4, 5, 3], key=key, fit_on=fit_on)
    row = found.metrics.first()
    assert row.accuracy > 0.9 and 20 < row.n < 80
    auto = run_autoencoder(spark, clouds, 0.7, 10, [4, 4, 4], key=key, fit_on=fit_on)
    assert 0 < auto.metrics.first().mse < 1
    assert {r.fold for r in auto.predictions.select("fold").distinct().collect()} <= {0, 1, 2, 3}
    with pytest.raises(ValueError):
        run_classification(spark, clouds, 1.0, 1, [4, 3])
