import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector

from bandnet.functions import network_output
from bandnet.operators import (
    RELU,
    SIGMOID,
    Activation,
    Affine,
    BlockObjective,
    Elementwise,
    HingeLoss,
    LeastSquaresLoss,
    LogisticLoss,
    MultinomialLoss,
    NetworkLoss,
    SigmoidSquaredError,
    SoftmaxCrossEntropy,
    SquaredError,
    Topology,
    encode,
    fit_network,
    formula_weights,
    forward,
    forward_all,
    gradient_frame,
    linear_sums,
    loss_frame,
    stack_blocks,
    unstack_blocks,
)
from bandnet.operators import objective as objective_module

rng = np.random.default_rng(5)
TANH = Activation("tanh", np.tanh, lambda z: 1 - z * z)
TOPOLOGIES = {
    "classifier": Topology.classifier([4, 6, 3]),
    "deep": Topology.classifier([4, 5, 6, 3], SIGMOID),
    "flat": Topology.classifier([4, 3]),
    "autoencoder": Topology.autoencoder([4, 2, 4]),
    "sigmoid": Topology((Affine(4, 5), Elementwise(SIGMOID), Affine(5, 3), SigmoidSquaredError())),
    "custom": Topology((Elementwise(TANH), Affine(4, 5), Elementwise(TANH), Elementwise(RELU), Affine(5, 3), SquaredError())),
}


@pytest.fixture()
def rows():
    gen = np.random.default_rng(11)
    return gen.normal(size=(23, 4)), gen.integers(0, 3, 23).astype(float)


@pytest.mark.parametrize("name", TOPOLOGIES)
def test_gradient_equals_finite_differences(name, rows):
    topology, (x, y) = TOPOLOGIES[name], rows
    loss = NetworkLoss(topology)
    w = np.random.default_rng(3).normal(size=topology.weight_count) * 0.7
    value, gradient = loss.partial(x, y, w)
    for i in np.random.default_rng(4).choice(len(w), min(len(w), 40), replace=False):
        step = np.zeros_like(w)
        step[i] = 1e-6
        slope = (loss.partial(x, y, w + step)[0] - loss.partial(x, y, w - step)[0]) / 2e-6
        assert abs(slope - gradient[i]) < 1e-5 * max(1.0, abs(slope)), (name, i)


def test_weight_layout():
    topology = Topology.classifier([2, 3])
    w = np.arange(9.0)
    (_, matrix, bias), _ = topology.layer_weights(w)
    # output index fastest, then the biases
    np.testing.assert_array_equal(matrix.T, [[0, 3], [1, 4], [2, 5]])
    np.testing.assert_array_equal(bias, [6, 7, 8])
    assert topology.weight_count == 9 and topology.sizes == [2, 3]
    assert Topology.classifier([200, 128, 64, 32, 17]).weight_count == 36625
    assert Topology.autoencoder([220, 140, 60, 140, 220]).weight_count == 78960


def test_topologies_are_checked():
    with pytest.raises(ValueError, match="expected 9 weights but got 8"):
        Topology.classifier([2, 3]).check(np.zeros(8))
    for build in (
        lambda: Topology.classifier([3]),
        lambda: Topology.classifier([3, 0]),
        lambda: Topology.autoencoder([3, 2]),
        lambda: Topology((Affine(2, 3),)),
        lambda: Topology((SquaredError(),)),
        lambda: Topology((Affine(2, 3), Affine(4, 2), SquaredError())),
        lambda: Topology((Affine(2, 3), SoftmaxCrossEntropy(), SquaredError())),
    ):
        with pytest.raises(ValueError):
            build()


def test_random_weights_by_seed():
    topology = Topology.classifier([16, 4, 2])
    w = topology.random_weights(7)
    np.testing.assert_array_equal(w, topology.random_weights(7))
    assert not np.array_equal(w, topology.random_weights(8))
    assert np.abs(w[:68]).max() <= 2.4 / 4 and np.abs(w[68:]).max() <= 2.4 / 2
    assert np.abs(w[68:]).max() > 2.4 / 4
    topology.random_weights(-3)


@pytest.mark.parametrize("name", TOPOLOGIES)
def test_table_gradient_equals_numpy(name, rows, make_rows):
    topology, (x, y) = TOPOLOGIES[name], rows
    w = formula_weights(topology.weight_count)
    loss, gradient = NetworkLoss(topology).partial(x, y, w)
    label = "label" if topology.target == "label" else None
    for partitions, size in ((1, 4), (5, 7), (30, 128)):
        blocks = stack_blocks(make_rows(x, y, partitions), 4, size, label=label)
        found = BlockObjective(blocks, NetworkLoss(topology), 4).evaluate(w)
        np.testing.assert_allclose(found.gradient, gradient / 23, atol=1e-12)
        assert found.count == 23 and abs(found.loss - loss / 23) < 1e-12


def test_float_blocks_give_the_gradient_of_their_values(rows, make_rows):
    topology, (x, y) = TOPOLOGIES["classifier"], rows
    w = formula_weights(topology.weight_count)
    x = x.astype(np.float32).astype(np.float64)
    df = make_rows(x, y).selectExpr("cast(features as array<float>) features", "label")
    found = BlockObjective(stack_blocks(df, 4, 5), NetworkLoss(topology), 4).evaluate(w)
    np.testing.assert_allclose(found.gradient, NetworkLoss(topology).partial(x, y, w)[1] / 23, atol=1e-12)


def test_partials_merge_in_a_tree(rows, make_rows, monkeypatch):
    topology, (x, y) = TOPOLOGIES["classifier"], rows
    w = formula_weights(topology.weight_count)
    wanted = NetworkLoss(topology).partial(x, y, w)[1] / 23
    blocks = stack_blocks(make_rows(x, y, 70), 4, 4)
    # 70 partitions need one merge level before the driver
    objective = BlockObjective(blocks, NetworkLoss(topology), 4)
    first, second = objective.evaluate(w), objective.evaluate(w)
    np.testing.assert_allclose(first.gradient, wanted, atol=1e-12)
    np.testing.assert_array_equal(first.gradient, second.gradient)
    assert first.count == 23
    merged = objective_module.merge_partials(blocks.limit(0).mapInArrow(lambda b: b, objective_module.PARTIAL_SCHEMA), 5000)
    plan = merged._jdf.queryExecution().analyzed().toString()
    assert plan.count("FlatMapGroupsInArrow") == 2


def test_block_average_weighs_blocks_alike(rows, make_rows):
    topology, (x, y) = TOPOLOGIES["classifier"], rows
    w = formula_weights(topology.weight_count)
    df = make_rows(x, y, 1)
    ordered = df.collect()
    ox, oy = np.array([r.features for r in ordered]), np.array([r.label for r in ordered])
    cuts = [(s, min(s + 5, 23)) for s in range(0, 23, 5)]
    means = [np.array(NetworkLoss(topology).partial(ox[a:b], oy[a:b], w)[1]) / (b - a) for a, b in cuts]
    found = BlockObjective(stack_blocks(df, 4, 5), NetworkLoss(topology), 4, "blocks").evaluate(w)
    np.testing.assert_allclose(found.gradient, np.mean(means, axis=0), atol=1e-12)
    assert found.count == 5
    frame = gradient_frame(df, topology, w, "blocks", block_size=5).collect()
    assert abs(sum(r.gradient for r in frame) - np.mean(means, axis=0).sum()) < 1e-12


def test_loss_and_gradient_frames(rows, make_rows):
    topology, (x, y) = TOPOLOGIES["autoencoder"], rows
    w = formula_weights(topology.weight_count)
    loss, gradient = NetworkLoss(topology).partial(x, y, w)
    df = make_rows(x, y)
    row = loss_frame(df, topology, w).first()
    assert row.units == 23 and abs(row.loss - loss / 23 / 4) < 1e-12
    got = {(r.layer, r.input, r.output): r.gradient for r in gradient_frame(df, topology, w).collect()}
    assert len(got) == topology.weight_count
    views = [v for v in topology.layer_weights(gradient / 23) if v[1] is not None]
    for layer, (_, matrix, bias) in enumerate(views):
        for (i, o), v in np.ndenumerate(matrix):
            assert abs(got[layer, i, o] - v) < 1e-12
        for o, v in enumerate(bias):
            assert abs(got[layer, -1, o] - v) < 1e-12


def test_large_logits_stay_finite(make_rows):
    topology = TOPOLOGIES["classifier"]
    x = rng.normal(size=(9, 4)) * 1e4
    loss, gradient = NetworkLoss(topology).partial(x, np.arange(9) % 3, formula_weights(topology.weight_count))
    assert np.isfinite(loss) and np.isfinite(gradient).all()
    for linear in (LogisticLoss(), MultinomialLoss(3)):
        loss, gradient = linear.partial(x, (np.arange(9) % 2).astype(float), np.full(linear.weight_count(4), 50.0))
        assert np.isfinite(loss) and np.isfinite(gradient).all()


@pytest.mark.parametrize("name", ["classifier", "deep", "autoencoder", "sigmoid"])
def test_scoring_kernel_and_expression_agree(name, rows, make_rows):
    topology, (x, y) = TOPOLOGIES[name], rows
    w = formula_weights(topology.weight_count)
    df = make_rows(x, y)
    both = forward(df, topology, w).withColumn("native", network_output("features", topology, w)).collect()
    np.testing.assert_allclose([r.output for r in both], [r.native for r in both], atol=1e-9)


def test_all_layers_and_code(rows, make_rows):
    topology, (x, y) = TOPOLOGIES["autoencoder"], rows
    w = formula_weights(topology.weight_count)
    got = encode(forward_all(make_rows(x, y), topology, w), topology, w).collect()
    for r in got:
        outputs = [np.array(o) for o in r.outputs]
        assert [len(o) for o in outputs] == [2, 2, 4, 4]
        np.testing.assert_array_equal(outputs[1], np.maximum(outputs[0], 0))
        np.testing.assert_array_equal(r.code, outputs[1])
    with pytest.raises(ValueError):
        flat = Topology.autoencoder([4, 4])
        encode(make_rows(x, y), flat, formula_weights(20))


def test_scoring_an_empty_table(spark):
    empty = spark.createDataFrame([], "features array<double>, label double")
    topology = TOPOLOGIES["classifier"]
    assert forward(empty, topology, formula_weights(topology.weight_count)).collect() == []


def test_same_model_as_the_builtin_without_hidden_layer(rows, make_rows):
    x, y = rows
    df = make_rows(x, y).withColumn("vector", array_to_vector("features"))
    builtin = MultilayerPerceptronClassifier(layers=[4, 3], maxIter=5, seed=1, featuresCol="vector").fit(df)
    topology = Topology.classifier([4, 3])
    scored = forward(builtin.transform(df), topology, builtin.weights).collect()
    np.testing.assert_allclose([r.output for r in scored], [r.probability.toArray() for r in scored], atol=1e-12)


LINEAR = {"logistic": (LogisticLoss(), 2), "three": (MultinomialLoss(3), 3), "squares": (LeastSquaresLoss(), 9), "hinge": (HingeLoss(), 2)}


@pytest.mark.parametrize("name", LINEAR)
def test_linear_losses(name, spark):
    loss, labels = LINEAR[name]
    gen = np.random.default_rng(8)
    x, y = gen.normal(size=(40, 3)) * 4, gen.integers(0, labels, 40).astype(float)
    w = gen.normal(size=loss.weight_count(3))
    value, gradient = loss.partial(x, y, w)
    rows = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "x0 double, x1 double, x2 double, y double")
    found = linear_sums(rows, 3, loss, w).first()
    assert found["n"] == 40 and abs(found["loss"] - value) < 1e-9
    np.testing.assert_allclose([found[f"g{i}"] for i in range(len(w))], gradient, atol=1e-9)
    for i in range(len(w)):
        step = np.zeros_like(w)
        step[i] = 1e-6
        slope = (loss.partial(x, y, w + step)[0] - loss.partial(x, y, w - step)[0]) / 2e-6
        assert abs(slope - gradient[i]) < 1e-4


def test_two_class_multinomial_is_logistic():
    gen = np.random.default_rng(2)
    x, y, w = gen.normal(size=(30, 4)), gen.integers(0, 2, 30).astype(float), gen.normal(size=4)
    a, b = LogisticLoss().partial(x, y, w), MultinomialLoss(2).partial(x, y, w)
    assert abs(a[0] - b[0]) < 1e-10
    np.testing.assert_allclose(a[1], b[1], atol=1e-10)
    with pytest.raises(ValueError):
        MultinomialLoss(1)


def test_target_vectors(spark):
    x, aim = rng.normal(size=(37, 4)), rng.normal(size=(37, 2))
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, aim)], "features array<double>, aim array<double>").repartition(3)
    blocks = stack_blocks(df, 4, 5, label=None, target="aim", target_width=2)
    back = {tuple(r.features): r.target for r in unstack_blocks(blocks, 4, target_width=2).collect()}
    for a, b in zip(x, aim):
        np.testing.assert_array_equal(back[tuple(a)], b)
    topology = Topology.regressor([4, 3, 2])
    w = rng.normal(size=topology.weight_count)
    loss, gradient = NetworkLoss(topology).partial(x, aim, w)
    found = BlockObjective(blocks, NetworkLoss(topology), 4).evaluate(w)
    np.testing.assert_allclose(found.loss, loss / 37)
    np.testing.assert_allclose(found.gradient, gradient / 37)
    assert loss_frame(df, topology, w, target="aim").first().loss == pytest.approx(loss / 37 / 2)
    step = np.zeros_like(w)
    step[3] = 1e-6
    numeric = (NetworkLoss(topology).partial(x, aim, w + step)[0] - NetworkLoss(topology).partial(x, aim, w - step)[0]) / 2e-6
    assert gradient[3] == pytest.approx(numeric, rel=1e-4)


@pytest.mark.parametrize("aim", [None, [1.0], [1.0, None], [1.0, float("nan")]])
def test_bad_target_vectors_are_refused(spark, aim):
    df = spark.createDataFrame([([1.0, 2.0], [0.5, 0.5]), ([3.0, 4.0], aim)], "features array<double>, target array<double>")
    topology = Topology.regressor([2, 2])
    with pytest.raises(Exception, match="needs 2 values|must not be null|must be finite"):
        loss_frame(df, topology, np.zeros(topology.weight_count)).collect()


def test_target_of_one_value(spark):
    df = spark.createDataFrame([([float(i)], [2.0 * i + 1]) for i in range(20)], "features array<double>, target array<double>")
    fit = fit_network(df, Topology.regressor([1, 1]), block_size=4, max_iter=50, seed=3)
    np.testing.assert_allclose(fit.weights, [2, 1], atol=1e-4)
