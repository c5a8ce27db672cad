"""Sparse blocks, products over weight tables, and the losses on either."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import types as T

from bandnet.operators import (
    BlockObjective, HingeLoss, LeastSquaresLoss, LogisticLoss, MultinomialLoss, NetworkLoss, SparseRows, Topology, affine, fit_network,
    formula_weights, sparse_linear_sums, stack_blocks, unstack_blocks, weight_frame,
)

WIDTH = 9


@pytest.fixture(scope="module")
def dense():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(57, WIDTH)) * (rng.random((57, WIDTH)) < 0.3)
    x[5] = 0
    return x, rng.integers(0, 3, 57).astype(float)


@pytest.fixture(scope="module")
def tables(spark, dense):
    """The same rows as sparse vectors, as a mix of both kinds of vectors, as structs, and as arrays."""
    x, y = dense
    sparse = [Vectors.sparse(WIDTH, [(int(i), float(r[i])) for i in np.flatnonzero(r)]) for r in x]
    mixed = [Vectors.dense(r) if k % 3 else s for k, (r, s) in enumerate(zip(x, sparse))]
    pairs = [{"indices": [int(i) for i in s.indices], "values": [float(v) for v in s.values]} for s in sparse]
    kinds = {
        "sparse": (sparse, VectorUDT()),
        "mixed": (mixed, VectorUDT()),
        "struct": (pairs, T.StructType().add("indices", T.ArrayType(T.IntegerType())).add("values", T.ArrayType(T.DoubleType()))),
        "array": ([r.tolist() for r in x], T.ArrayType(T.DoubleType())),
    }
    out = {}
    for name, (rows, kind) in kinds.items():
        schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("features", kind), T.StructField("label", T.DoubleType())])
        out[name] = spark.createDataFrame(list(zip(range(len(y)), rows, y.tolist())), schema).repartition(3, "id")
    return out


def test_products_of_sparse_rows(dense):
    x, _ = dense
    cuts = np.concatenate([[0], np.cumsum((x != 0).sum(axis=1))])
    rows = SparseRows(x[x != 0], np.nonzero(x)[1], cuts, WIDTH)
    m, left = np.random.default_rng(0).normal(size=(WIDTH, 4)), np.random.default_rng(1).normal(size=(3, len(x)))
    assert np.allclose(rows @ m, x @ m) and np.allclose(rows @ m[:, 0], x @ m[:, 0])
    assert np.allclose(left @ rows, left @ x) and np.allclose(rows.T @ left.T, x.T @ left.T)
    assert np.allclose(rows.toarray(), x) and np.allclose(np.ones(x.shape) - rows, 1 - x)
    assert np.allclose(rows[5:9].toarray(), x[5:9]) and len(rows[57:]) == 0
    keep = np.arange(57) % 4 == 1
    assert np.allclose(rows.where(keep).toarray(), x[keep])


@pytest.mark.parametrize("kind", ["sparse", "mixed", "struct", "array"])
@pytest.mark.parametrize("loss", [LogisticLoss(), MultinomialLoss(3), LeastSquaresLoss(), HingeLoss()])
def test_linear_losses_on_sparse_blocks(dense, tables, kind, loss):
    x, y = dense
    w = formula_weights(loss.weight_count(WIDTH))
    total, gradient = loss.partial(x, y, w)
    found = BlockObjective(stack_blocks(tables[kind], WIDTH, 8, sparse=True), loss, WIDTH).evaluate(w)
    assert found.count == 57 and found.loss == pytest.approx(total / 57) and np.allclose(found.gradient, gradient / 57)
    sums = {r.position: r.total for r in sparse_linear_sums(tables[kind], loss, w, WIDTH).collect()}
    assert sums[-2] == 57 and sums[-1] == pytest.approx(total)
    assert np.allclose([sums.get(i, 0.0) for i in range(len(w))], gradient)


@pytest.mark.parametrize("topology", [Topology.classifier([WIDTH, 5, 3]), Topology.autoencoder([WIDTH, 4, WIDTH])])
def test_networks_on_sparse_blocks(dense, tables, topology):
    x, y = dense
    loss, w = NetworkLoss(topology), formula_weights(topology.weight_count)
    label = "label" if topology.target == "label" else None
    total, gradient = loss.partial(x, y, w)
    found = BlockObjective(stack_blocks(tables["mixed"], WIDTH, 8, label=label, sparse=True), loss, WIDTH).evaluate(w)
    assert found.loss == pytest.approx(total / 57) and np.allclose(found.gradient, gradient / 57)


def test_sparse_training_is_dense_training(tables):
    options = {"max_iter": 4, "block_size": 16, "seed": 2}
    topology = Topology.classifier([WIDTH, 4, 3])
    a = fit_network(tables["sparse"], topology, sparse=True, **options)
    b = fit_network(tables["array"], topology, **options)
    assert np.allclose(a.weights, b.weights, atol=1e-8) and np.allclose(a.history, b.history)
    part = {"solver": "gd", "fraction": 0.4, "key": "id", "max_iter": 5, "tol": 0.0, "step_size": 0.1}
    a = fit_network(tables["sparse"], topology, sparse=True, **part)
    b = fit_network(tables["array"].repartition(5), topology, **part)
    assert np.allclose(a.weights, b.weights, atol=1e-10)


def test_unstacked_sparse_blocks(dense, tables):
    x, _ = dense
    rows = unstack_blocks(stack_blocks(tables["struct"], WIDTH, 8, sparse=True), WIDTH).collect()
    assert sorted(tuple(r.features) for r in rows) == sorted(tuple(r) for r in x.tolist())


@pytest.mark.parametrize("kind", ["sparse", "mixed", "struct", "array"])
def test_affine_over_a_weight_table(spark, dense, tables, kind):
    x, _ = dense
    topology = Topology.regressor([WIDTH, 4])
    w = formula_weights(topology.weight_count)
    layer = weight_frame(spark, topology, w).select("input", "output", "value")
    found = {r.id: r.output for r in affine(tables[kind], layer).collect()}
    _, matrix, bias = next(topology.layer_weights(w))
    assert np.allclose([found[i] for i in range(57)], x @ matrix + bias)


def test_affine_of_odd_rows(spark, tables):
    layer = spark.createDataFrame([(0, 0, 2.0), (0, 1, 3.0), (1, 0, 5.0), (1, 1, 7.0), (-1, 0, 0.5), (-1, 1, 0.25)], "input int, output int, value double")
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, []), (4, [4.0])], "id int, features array<double>")
    found = {r.id: r.output for r in affine(rows, layer).collect()}
    assert found == {1: [12.5, 17.25], 2: None, 3: [0.5, 0.25], 4: [8.5, 12.25]}
    assert affine(rows.limit(0), layer).count() == 0
    with pytest.raises(Exception, match="no weight for input 2"):
        affine(spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "id int, features array<double>"), layer).collect()
    plan = affine(tables["array"], layer)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_bad_sparse_rows(spark):
    schema = "features struct<indices: array<int>, values: array<double>>, label double"
    for entry in ({"indices": [9], "values": [1.0]}, {"indices": [-1], "values": [1.0]}, {"indices": [1, 2], "values": [1.0]}, None):
        df = spark.createDataFrame([(entry, 0.0)], schema)
        with pytest.raises(Exception):
            stack_blocks(df, WIDTH, sparse=True).collect()
    short = spark.createDataFrame([(Vectors.sparse(4, [1], [1.0]), 0.0)], ["features", "label"])
    with pytest.raises(Exception, match="must have 9 values"):
        stack_blocks(short, WIDTH, sparse=True).collect()
    empty = spark.createDataFrame([], schema)
    assert BlockObjective(stack_blocks(empty, WIDTH, sparse=True), LogisticLoss(), WIDTH).evaluate(np.zeros(WIDTH)).count == 0
