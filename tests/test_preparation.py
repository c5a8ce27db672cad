import numpy as np
import pytest
from pyspark.ml.feature import MinMaxScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from bandnet.operators import (
    check_labels,
    k_folds,
    minmax_columns,
    minmax_fit,
    minmax_scale,
    random_split,
    split_by_key,
    stack_blocks,
    unstack_blocks,
)

X = np.array([[1.0, 5.0, -2.0], [3.0, 5.0, 0.0], [2.0, 5.0, 6.0], [0.0, 5.0, 2.0]])


def test_scaling_matches_the_builtin(spark, make_rows):
    df = make_rows(X)
    bounds = minmax_fit(df)
    np.testing.assert_array_equal(bounds.low, X.min(axis=0))
    np.testing.assert_array_equal(bounds.high, X.max(axis=0))
    vectors = df.select(array_to_vector("features").alias("features"))
    wanted = MinMaxScaler(inputCol="features", outputCol="s").fit(vectors).transform(vectors)
    got = sorted(list(r.features) for r in minmax_scale(df, bounds).collect())
    np.testing.assert_allclose(got, sorted(list(r.s) for r in wanted.collect()), atol=1e-15)


def test_unseen_values_are_not_clipped(make_rows):
    bounds = minmax_fit(make_rows(X))
    got = minmax_scale(make_rows([[6.0, 9.0, -10.0]]), bounds).first().features
    assert got == [2.0, 0.5, -1.0]


def test_scaled_columns(spark):
    df = spark.createDataFrame([(1.0, 7.0, None), (3.0, 7.0, None)], "a double, b double, c double")
    assert sorted(tuple(r) for r in minmax_columns(df, ["a", "b", "c"]).collect()) == [(0.0, 0.5, None), (1.0, 0.5, None)]


def test_key_split_is_repeatable_and_complete(spark):
    df = spark.range(5000)
    parts = split_by_key(df, "id", [0.7, 0.2, 0.1])
    first = {r.id: r.split for r in parts.collect()}
    again = {r.id: r.split for r in split_by_key(df.repartition(9), "id", [0.7, 0.2, 0.1]).collect()}
    assert first == again and len(first) == 5000
    shares = np.bincount(list(first.values())) / 5000
    np.testing.assert_allclose(shares, [0.7, 0.2, 0.1], atol=0.03)
    folds = k_folds(parts.where("split = 1"), "id", 4).groupBy("fold").count().collect()
    assert sorted(r.fold for r in folds) == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        split_by_key(df, "id", [0.5, -0.5])


def test_random_split_covers_every_row(spark):
    a, b = random_split(spark.range(1000), [0.8, 0.2])
    ids = [r.id for r in a.collect()] + [r.id for r in b.collect()]
    assert sorted(ids) == list(range(1000))


def test_blocks_are_cut_within_partitions(make_rows):
    x = np.arange(30.0).reshape(10, 3)
    df = make_rows(x, range(10), partitions=3)
    sizes = [len(p) for p in df.rdd.glom().collect()]
    got = sorted(r.n for r in stack_blocks(df, 3, 4).collect())
    wanted = sorted(n for s in sizes for n in ([4] * (s // 4) + ([s % 4] if s % 4 else [])))
    assert got == wanted
    back = {r.label: r.features for r in unstack_blocks(stack_blocks(df, 3, 4), 3).collect()}
    assert back == {float(i): list(r) for i, r in enumerate(x)}


@pytest.mark.parametrize("batch", ["1", "3", "10000"])
def test_blocks_do_not_depend_on_arrow_batches(spark, make_rows, batch):
    x = np.arange(22.0).reshape(11, 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        blocks = stack_blocks(make_rows(x, range(11), partitions=1), 2, 4).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [r.n for r in blocks] == [4, 4, 3]


def test_blocks_without_labels(make_rows):
    blocks = stack_blocks(make_rows(X), 3, 2, label=None)
    assert {len(r.y) for r in blocks.collect()} == {0}
    rows = unstack_blocks(blocks, 3).collect()
    assert len(rows) == 4 and all(r.label is None for r in rows)
    with pytest.raises(ValueError):
        stack_blocks(make_rows(X), 3, 0)


def test_float_features_keep_their_value(spark):
    df = spark.createDataFrame([([0.1, 0.2], 1.0)], "features array<float>, label double")
    blocks = stack_blocks(df, 2, 8)
    assert len(blocks.first().x) == 8 and len(blocks.first().y) == 8
    row = unstack_blocks(blocks, 2).first()
    assert row.features == [float(np.float32(0.1)), float(np.float32(0.2))]


@pytest.mark.parametrize("bad", [3.0, -1.0, None, 1.5, float("nan")])
def test_bad_labels_are_found_before_training(spark, bad):
    df = spark.createDataFrame([(0.0,), (2.0,), (bad,)], "label double")
    with pytest.raises(ValueError, match="1 rows have a label outside 0..2"):
        check_labels(df, "label", 3)


def test_good_labels_pass(spark):
    check_labels(spark.createDataFrame([(0,), (2,)], "label int"), "label", 3)
    check_labels(spark.createDataFrame([], "label int"), "label", 3)
