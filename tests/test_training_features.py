"""Counters, minibatches by key, optimizers of one's own, restarts, one read of the source, splits without a key."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandnet import DenseAutoencoder, DenseClassifier, run_classification
from bandnet.functions import permuted_array, permuted_column, sampled_array, uniform_array, uniform_column
from bandnet.functions.columns import LITERAL_LIMIT, affine
from bandnet.functions.counter import PRIME
from bandnet.operators import (
    BlockObjective, ColumnObjective, Fit, GradientDescent, Lbfgs, LbfgsState, LeastSquaresLoss, LogisticLoss, NetworkLoss, StateFolder,
    Topology, fit_network, formula_weights, l2_step, linear_sums, minimize_gd, minimize_lbfgs, random_split, random_weight_frame,
    solve_nonnegative, split_rows, stack_blocks, state_frame, state_from_frame,
)
from bandnet.operators.arrow import small_batches
from bandnet.operators.losses import ScaledLoss
from bandnet.operators.nnls import solve_nonnegative_batch


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(90, 4)) * [1, 10, 100, 0] + [0, 5, 0, 3]
    return x, (x[:, 0] > 0).astype(float)


@pytest.fixture()
def rows(make_rows, data):
    x, y = data
    return make_rows(x, y, partitions=0).withColumn("id", F.monotonically_increasing_id()).repartition(4, "label", "features")


def test_counter_is_a_permutation_and_alike_in_spark(spark):
    numbers = np.arange(20_000)
    for seed in (0, 7, -3, 2**70):
        assert len(np.unique(permuted_array(numbers, seed))) == len(numbers)
    drawn = uniform_array(numbers, 7)
    assert abs(drawn.mean() - 0.5) < 0.01 and abs(drawn.std() - 12**-0.5) < 0.01
    assert abs(np.corrcoef(drawn, uniform_array(numbers, 8))[0, 1]) < 0.03
    got = spark.range(500).select("id", permuted_column(F.col("id"), 7).alias("p"), uniform_column(F.col("id"), 7).alias("u")).collect()
    assert all(r.p == permuted_array(np.array([r.id]), 7)[0] and r.u == drawn[r.id] for r in got)
    assert abs(sampled_array(numbers, 0.25, 3).mean() - 0.25) < 0.02 and PRIME == 2**31 - 1


def test_random_weights_alike_in_spark(spark):
    topology = Topology.classifier([5, 7, 3])
    flat = topology.random_weights(11)
    frame = {(r.layer, r.input, r.output): r.value for r in random_weight_frame(spark, topology, 11).collect()}
    for number, (start, inputs, outputs) in enumerate(topology.weight_coordinates()):
        for at in range(inputs * outputs + outputs):
            source = at // outputs if at < inputs * outputs else -1
            assert frame.pop((number, source, at % outputs)) == pytest.approx(flat[start + at], rel=1e-14)
    assert not frame and np.abs(flat[:42]).max() <= 2.4 / np.sqrt(5) and not np.allclose(flat, topology.random_weights(12))


def test_minibatches_by_key_do_not_depend_on_the_layout(rows, data):
    loss, w = LeastSquaresLoss(), formula_weights(4)
    found = []
    for n in (1, 3, 7):
        blocks = stack_blocks(rows.repartition(n), 4, 5, key="id")
        found.append(BlockObjective(blocks, loss, 4).evaluate(w, 0.4, 9))
    columns = ColumnObjective(rows.select("label", "id", *[F.col("features")[i].alias(f"f{i}") for i in range(4)]), [f"f{i}" for i in range(4)], "label", loss, key="id")
    found.append(columns.evaluate(w, 0.4, 9))
    assert 0 < found[0].count < 90 and len({f.count for f in found}) == 1
    assert all(np.allclose(f.gradient, found[0].gradient) and f.loss == pytest.approx(found[0].loss) for f in found)
    assert not np.allclose(columns.evaluate(w, 0.4, 10).gradient, found[0].gradient)
    with pytest.raises(ValueError, match="averaging"):
        BlockObjective(stack_blocks(rows, 4, key="id"), loss, 4, "blocks")
    with pytest.raises(Exception, match="must not be null"):
        stack_blocks(rows.withColumn("id", F.lit(None).cast("long")), 4, key="id").collect()


class Walk:
    """An optimizer that takes signs for steps."""

    def optimize(self, objective, initial):
        w, losses = np.array(initial), []
        for _ in range(3):
            found = objective.evaluate(w)
            losses.append(found.loss * objective.report_scale)
            w = w - 0.01 * np.sign(found.gradient)
        return Fit(w, losses, 3, reason="walked")


def test_an_optimizer_of_ones_own(rows):
    topology = Topology.classifier([4, 2])
    start = formula_weights(topology.weight_count)
    fit = fit_network(rows, topology, solver=Walk(), initial_weights=start)
    assert fit.reason == "walked" and len(fit.history) == 3 and np.allclose(np.abs(fit.weights - start).max(), 0.03)
    model = DenseClassifier(layers=[4, 2], initialWeights=start).setOptimizer(Walk()).fit(rows)
    assert np.array_equal(model.weights.toArray(), fit.weights)
    named = fit_network(rows, topology, solver="gd", max_iter=3, step_size=0.1, tol=0.0, initial_weights=start, updater=l2_step, reg=0.5)
    built = fit_network(rows, topology, solver=GradientDescent(l2_step, 0.1, 3, 0.5, tol=0.0), initial_weights=start)
    assert np.array_equal(named.weights, built.weights)
    seen = []
    estimator = DenseClassifier(layers=[4, 2], solver="gd", maxIter=3, stepSize=0.1, tol=0.0, initialWeights=start, regParam=0.5)
    model = estimator.setUpdater(l2_step).setOnIteration(lambda *now: seen.append(now)).copy().fit(rows)
    assert np.array_equal(model.weights.toArray(), named.weights) and [i for i, _, _ in seen] == [1, 2, 3]
    for bad in (object(), "newton"):
        with pytest.raises(ValueError):
            fit_network(rows, topology, solver=bad)


def test_lbfgs_goes_on_to_the_bit(spark, rows, tmp_path):
    topology = Topology.classifier([4, 3, 2])
    with_states: list[LbfgsState] = []
    blocks = stack_blocks(rows, 4, 16).persist()
    objective, start = BlockObjective(blocks, NetworkLoss(topology), 4), topology.random_weights(1)
    whole = minimize_lbfgs(objective, start, iterations=12, corrections=4, on_state=with_states.append)
    assert len(with_states) == 12 and [s.iteration for s in with_states] == list(range(1, 13))
    for cut in (1, 5, 11):
        state = state_from_frame(state_frame(spark, with_states[cut - 1]).repartition(3))
        again = minimize_lbfgs(objective, start, iterations=12, corrections=4, resume=state)
        assert again.history == whole.history and np.array_equal(again.weights, whole.weights) and again.evaluations == whole.evaluations
    folder = StateFolder(spark, str(tmp_path / "states"), every=2)
    assert folder.latest() is None
    for state in with_states[:5]:
        folder.save(state)
    assert folder.iterations() == [4] and folder.latest().iteration == 4
    (tmp_path / "states" / "iteration-6").mkdir()  # cut while writing
    assert folder.latest().iteration == 4
    folder.clear()
    assert folder.latest() is None
    with pytest.raises(ValueError, match="weights"):
        minimize_lbfgs(objective, start[:-1], resume=with_states[0])
    blocks.unpersist()


def test_the_trainer_goes_on(rows, tmp_path):
    topology = Topology.classifier([4, 3, 2])
    options = {"initial_weights": topology.random_weights(1), "block_size": 16}
    whole = fit_network(rows, topology, max_iter=8, **options)
    path = str(tmp_path / "run")
    fit_network(rows, topology, max_iter=3, restart=path, **options)
    on = fit_network(rows, topology, max_iter=8, restart=path, **options)
    assert on.history == whole.history and np.array_equal(on.weights, whole.weights)
    with pytest.raises(ValueError, match="restart"):
        fit_network(rows, topology, solver="gd", restart=path)


def test_scaling_inside_the_kernel(spark, rows, data):
    x, y = data
    marked = rows.withColumn("use", F.col("id") % 3 != 0)
    topology, options = Topology.classifier([4, 3, 2]), {"max_iter": 5, "seed": 4, "block_size": 16}
    for kind, of in (("all", marked), ("train", marked.where("use"))):
        fit = fit_network(marked, topology, part="use", scaling=kind, **options)
        known = np.array([list(r.features) for r in of.collect()])
        low, high = known.min(axis=0), known.max(axis=0)
        assert np.array_equal(fit.bounds[0], low) and np.array_equal(fit.bounds[1], high)
        spread = np.where(high == low, 1, high - low)
        scale = F.udf(lambda v: [0.5 if h == l else (a - l) / s for a, l, h, s in zip(v, low.tolist(), high.tolist(), spread.tolist())], "array<double>")
        plain = fit_network(marked.where("use").withColumn("features", scale("features")), topology, **options)
        assert np.allclose(plain.history, fit.history) and np.allclose(plain.weights, fit.weights, atol=1e-6)
    plan_rows = spark.createDataFrame([], rows.schema).withColumn("use", F.lit(True))
    empty = fit_network(plan_rows, topology, part="use", scaling="all", **options)
    assert empty.bounds is None and len(empty.history) == 0
    bad = rows.withColumn("label", F.when(F.col("id") == 5, F.lit(2.0)).otherwise(F.col("label")))
    with pytest.raises(ValueError, match="1 rows have a label outside 0..1, for example 2.0"):
        fit_network(bad, topology, **options)
    nothing = rows.withColumn("label", F.when(F.col("id") != 5, F.col("label")))
    with pytest.raises(ValueError, match="1 rows have a label outside 0..1, for example null"):
        fit_network(nothing, topology, **options)
    total, _ = ScaledLoss(LogisticLoss(), x.min(axis=0), x.max(axis=0)).partial(x, y, np.zeros(4))
    assert total == pytest.approx(90 * np.log(2))


def test_jobs_read_the_source_once_before_the_loop(spark, rows, tmp_path):
    """Rows are counted where they are read: once for training, once for the scores of the others."""
    path = str(tmp_path / "rows.parquet")
    rows.write.parquet(path)
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    source = spark.read.parquet(path).mapInArrow(count, rows.schema)
    result = run_classification(spark, source, 0.7, 3, layers=[4, 3, 2], key="id")
    assert read.value == 90
    result.metrics.collect()
    assert read.value == 180


def test_splits_without_a_key(spark):
    df = spark.range(3000).selectExpr("id % 40 AS a", "CASE WHEN id % 3 = 0 THEN NULL ELSE 'x' END AS b", "array(id % 2) AS c")
    one = split_rows(df.repartition(3), [0.5, 0.3, 0.2], 5).groupBy("a", "b", "c", "split").count().collect()
    two = split_rows(df.repartition(7, "a"), [0.5, 0.3, 0.2], 5).groupBy("a", "b", "c", "split").count().collect()
    assert sorted(one, key=str) == sorted(two, key=str) and sum(r["count"] for r in one) == 3000
    shares = [sum(r["count"] for r in one if r.split == i) / 3000 for i in range(3)]
    assert np.allclose(shares, [0.5, 0.3, 0.2], atol=0.05)
    three = split_rows(df, [0.5, 0.3, 0.2], 6).groupBy("a", "b", "c", "split").count().collect()
    assert sorted(one, key=str) != sorted(three, key=str)
    clash = df.withColumnRenamed("a", "split")
    parts = random_split(clash, [0.5, 0.5])
    assert [p.columns for p in parts] == [["split", "b", "c"]] * 2 and sum(p.count() for p in parts) == 3000
    assert split_rows(df.limit(0), [0.5, 0.5]).count() == 0


def test_wide_columns_go_through_the_kernel(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(40, 60)), rng.normal(size=40)
    table = [(*map(float, r), float(v)) for r, v in zip(x, y)]
    names = [f"x{i}" for i in range(60)]
    df = spark.createDataFrame(table, [*names, "y"])
    w = formula_weights(60)
    total, gradient = LeastSquaresLoss().partial(x, y, w)
    row = linear_sums(df, 60, LeastSquaresLoss(), w).first()
    assert row.n == 40 and row.loss == pytest.approx(total) and np.allclose([row[f"g{i}"] for i in range(60)], gradient)
    assert linear_sums(df.limit(0), 60, LeastSquaresLoss(), w).first().n == 0
    objective = ColumnObjective(df, names, "y", LeastSquaresLoss())
    assert np.allclose(objective.evaluate(w).gradient, gradient / 40)
    fit = minimize_gd(objective, w, step=0.01, iterations=2, tol=0.0, fraction=0.5)
    assert len(fit.history) == 2


def test_batched_nonnegative_systems():
    rng = np.random.default_rng(0)
    for n in (1, 3, 6):
        a = rng.normal(size=(300, n + 2, n))
        a[::9, :, 0] = 0
        if n > 2:
            a[::11, :, 1] = a[::11, :, 2]
        grams, rhs = np.einsum("kij,kil->kjl", a, a), np.einsum("kij,ki->kj", a, rng.normal(size=(300, n + 2)))
        found = solve_nonnegative_batch(grams, rhs)
        alone = np.array([solve_nonnegative(g, b[None])[0] for g, b in zip(grams, rhs)])
        value = lambda x: np.einsum("ki,kij,kj->k", x, grams, x) / 2 - (x * rhs).sum(axis=1)
        assert (found >= 0).all() and np.allclose(value(found), value(alone), atol=1e-9)
    assert solve_nonnegative_batch(np.empty((0, 2, 2)), np.empty((0, 2))).shape == (0, 2)


def test_batch_sizes_are_kept_by_session(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    other = spark.newSession()
    other.conf.set(name, "9m")
    before = spark.conf.get(name)
    with small_batches(spark):
        with small_batches(other, "1m"):
            assert (spark.conf.get(name), other.conf.get(name)) == ("4m", "1m")
        assert (spark.conf.get(name), other.conf.get(name)) == ("4m", "9m")
    assert (spark.conf.get(name), other.conf.get(name)) == (before, "9m")


def test_literals_are_bounded():
    with pytest.raises(ValueError, match="too many for an expression"):
        affine("x", np.zeros((LITERAL_LIMIT + 1, 1)), np.zeros(LITERAL_LIMIT + 1))


def test_estimator_settings_reach_the_solver(rows):
    estimator = DenseAutoencoder(layers=[4, 2, 4], maxIter=2, seed=1, corrections=3, regParam=0.1, keyCol="id", restartFolder="")
    options = estimator._training_options()
    assert (options["corrections"], options["reg"], options["key"], options["restart"], options["sparse"]) == (3, 0.1, "id", None, False)
    for bad in ({"corrections": 0}, {"regParam": -1.0}):
        with pytest.raises(ValueError):
            DenseAutoencoder(layers=[4, 2, 4], **bad)
    again = Lbfgs(iterations=1).optimize(BlockObjective(stack_blocks(rows, 4, label=None), NetworkLoss(Topology.autoencoder([4, 2, 4])), 4), np.full(22, 0.1))
    assert len(again.history) == 2
