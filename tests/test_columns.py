import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from bandnet import functions as C


@pytest.fixture(scope="module")
def one(spark):
    rows = [([1.0, -2.0, 0.0, 3.0],), ([1000.0, 999.0, -1000.0, 1000.0],)]
    return spark.createDataFrame(rows, "a array<double>")


def values(df, col):
    return [np.array(r[0]) for r in df.select(col).collect()]


def test_activations(one):
    a = values(one, F.col("a"))
    for got, x in zip(values(one, C.relu("a")), a):
        np.testing.assert_array_equal(got, np.maximum(x, 0))
    for got, x in zip(values(one, C.sigmoid("a")), a):
        np.testing.assert_allclose(got, 1 / (1 + np.exp(-np.clip(x, -700, 700))), atol=1e-12)
    for got, x in zip(values(one, C.relu_grad("a")), a):
        np.testing.assert_array_equal(got, (x > 0).astype(float))
    np.testing.assert_allclose(values(one, C.sigmoid_grad("a"))[0], (1 - a[0]) * a[0])


def test_softmax_stays_finite(one):
    for got, x in zip(values(one, C.softmax("a")), values(one, F.col("a"))):
        e = np.exp(x - x.max())
        np.testing.assert_allclose(got, e / e.sum(), rtol=1e-12)


def test_affine_and_dot(one):
    w, b = np.arange(8.0).reshape(2, 4), np.array([0.5, -0.25])
    for got, x in zip(values(one, C.affine("a", w, b)), values(one, F.col("a"))):
        np.testing.assert_allclose(got, w @ x + b)
    assert one.select(C.dot("a", "a")).first()[0] == 14.0
    with pytest.raises(ValueError):
        C.affine("a", w, np.zeros(3))
    with pytest.raises(ValueError):
        C.double_array_literal([float("nan")])


def test_argmax_takes_the_first_of_ties(one):
    assert [r[0] for r in one.select(C.argmax("a")).collect()] == [3.0, 0.0]


def test_one_hot(spark):
    df = spark.createDataFrame([(0.0,), (2.0,)], "label double")
    assert [r[0] for r in df.select(C.one_hot("label", 3)).collect()] == [[1.0, 0.0, 0.0], [0.0, 0.0, 1.0]]
    for bad in (3.0, -1.0, None):
        wrong = spark.createDataFrame([(bad,)], "label double")
        with pytest.raises(Exception, match="label outside"):
            wrong.select(C.one_hot("label", 3)).collect()


def test_feature_array_accepts_vectors_and_arrays(spark):
    vectors = spark.createDataFrame([(Vectors.sparse(3, [1], [2.0]),), (Vectors.dense(1, 2, 3),)], ["features"])
    assert [r[0] for r in vectors.select(C.feature_array(vectors, "features")).collect()] == [[0, 2, 0], [1, 2, 3]]
    whole = spark.createDataFrame([([1, 2],)], "features array<int>")
    assert whole.select(C.feature_array(whole, "features")).first()[0] == [1.0, 2.0]
    with pytest.raises(TypeError):
        C.feature_array(spark.createDataFrame([("x",)], "features string"), "features")


def test_feature_width_is_checked(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0],)], "features array<double>")
    with pytest.raises(Exception, match="needs 2 values, found 1"):
        df.select(C.feature_array(df, "features", 2)).collect()
    missing = spark.createDataFrame([(None,)], "features array<double>")
    with pytest.raises(Exception, match="found null"):
        missing.select(C.feature_array(missing, "features", 2)).collect()


def test_split_bucket_depends_on_key_and_salt_only(spark):
    df = spark.range(2000)
    one = {r[0]: r[1] for r in df.repartition(1).select("id", C.split_bucket("id", "a")).collect()}
    many = {r[0]: r[1] for r in df.repartition(7).select("id", C.split_bucket("id", "a")).collect()}
    other = {r[0]: r[1] for r in df.select("id", C.split_bucket("id", "b")).collect()}
    assert one == many and one != other
    assert 0 <= min(one.values()) and max(one.values()) < 1000
