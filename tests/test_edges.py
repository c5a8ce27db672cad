"""Nulls, NaN, bad labels, missing cells and tiny parts: a defined answer or an error, never a silent one."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandnet import functions as C
from bandnet.operators import (
    LeastSquaresLoss,
    NetworkLoss,
    Topology,
    accuracy,
    formula_weights,
    gram_matrix,
    k_folds,
    linear_sums,
    minimize_lbfgs,
    reconstruction_mse,
    split_by_key,
)
from bandnet.operators import nnls
from bandnet.operators.optimizers import Evaluation
from bandnet.sources import cube_to_pixels, pixels_to_cube


def test_splits_lose_no_part(spark):
    keys = spark.range(200_000)
    counts = dict(split_by_key(keys, "id", [0.9996, 0.0004]).groupBy("split").count().collect())
    assert set(counts) == {0, 1} and 40 < counts[1] < 130
    folds = dict(k_folds(keys, "id", 3).groupBy("fold").count().collect())
    assert set(folds) == {0, 1, 2} and max(folds.values()) - min(folds.values()) < 1500
    assert k_folds(keys, "id", 2000).select("fold").distinct().count() == 2000
    with pytest.raises(ValueError, match="too small"):
        split_by_key(keys, "id", [1.0, 1e-30])
    with pytest.raises(Exception, match="must not be null"):
        k_folds(spark.sql("SELECT cast(null AS long) AS id"), "id", 3).collect()


def test_cross_entropy_is_never_null(spark):
    rows = spark.sql("SELECT array(0.0D, 1.0D) AS p, 0 AS y UNION ALL SELECT array(0.5D, 0.5D), 1")
    losses = sorted(r[0] for r in rows.select(C.cross_entropy("p", "y")).collect())
    assert losses == [pytest.approx(math.log(2)), math.inf]
    for label in ("-1", "1.5", "2", "null", "double('NaN')"):
        bad = spark.sql(f"SELECT array(0.5D, 0.5D) AS p, cast({label} AS double) AS y")
        with pytest.raises(Exception, match="no probability for label"):
            bad.select(C.cross_entropy("p", "y")).collect()
        with pytest.raises(Exception, match="label outside 0..1"):
            bad.select(C.one_hot("y", 2)).collect()


@pytest.mark.parametrize("label", [-1.0, 1.5, 2.0, math.nan])
def test_networks_refuse_bad_labels(label):
    topology = Topology.classifier([3, 2])
    with pytest.raises(ValueError, match="label outside 0..1"):
        NetworkLoss(topology).partial(np.ones((1, 3)), np.array([label]), formula_weights(topology.weight_count))


def test_linear_sums_count_what_they_add(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (None, 3.0), (2.0, None), (math.nan, 1.0), (3.0, 1.0)], "x0 double, y double")
    whole = rows.where("x0 IN (1, 3) AND y IS NOT NULL")
    assert linear_sums(rows, 1, LeastSquaresLoss(), [0.5]).first() == linear_sums(whole, 1, LeastSquaresLoss(), [0.5]).first()
    assert linear_sums(rows, 1, LeastSquaresLoss(), [0.5]).first()["n"] == 2


def test_scores_with_nulls(spark):
    rows = spark.sql("SELECT array(1.0D, 1.0D) AS features, array(2.0D, 2.0D) AS prediction UNION ALL SELECT array(5.0D, 5.0D), null")
    assert reconstruction_mse(rows).first()["mse"] == 1.0
    uneven = spark.sql("SELECT array(1.0D, 1.0D) AS features, array(2.0D) AS prediction")
    with pytest.raises(Exception, match="2 values against a prediction of 1"):
        reconstruction_mse(uneven).collect()
    scored = spark.sql("SELECT 1.0D AS prediction, 1.0D AS label UNION ALL SELECT null, 1.0D")
    assert accuracy(scored).first() == (0.5, 2)


def test_cubes_keep_bands_in_place(spark):
    cells = spark.sql("SELECT 0 AS row, 0 AS col, 0 AS band, 5.0D AS value UNION ALL SELECT 0, 0, 2, 7.0D")
    with pytest.raises(Exception, match="lacks a band"):
        cube_to_pixels(cells).collect()
    with pytest.raises(Exception, match="lacks a band"):
        cube_to_pixels(cells.where("band = 0"), bands=3).collect()
    filled = cube_to_pixels(cells, bands=4, fill=-1.0)
    assert filled.first()["features"] == [5.0, -1.0, 7.0, -1.0]
    assert pixels_to_cube(filled).where("band = 2").first()["value"] == 7.0
    with pytest.raises(ValueError, match="number of bands"):
        cube_to_pixels(cells, fill=0.0)


def test_optimizer_refuses_nan_and_says_why_it_ended():
    class Bowl:
        report_scale = 1.0

        def __init__(self, scale):
            self.scale = scale

        def evaluate(self, w, fraction=1.0, seed=None):
            return Evaluation(float(self.scale * w @ w), 2 * self.scale * w, 1)

    with pytest.raises(ValueError, match="not finite"):
        minimize_lbfgs(Bowl(math.nan), np.ones(2))
    small = minimize_lbfgs(Bowl(1e-10), np.ones(2))
    assert small.reason == "the gradient is small" and small.weights[0] == 1.0
    assert abs(minimize_lbfgs(Bowl(1e-10), np.ones(2), gradient_floor=0.0).weights[0]) < 1e-3


def test_wide_sums_equal_narrow_ones(spark, monkeypatch):
    rng = np.random.default_rng(0)
    data = [(int(k), None if i == 3 else float(a), float(b), float(y)) for i, (k, a, b, y) in enumerate(zip(rng.integers(0, 3, 60), *rng.normal(size=(3, 60))))]
    rows = spark.createDataFrame(data, "k int, a double, b double, y double").repartition(4)

    def found(keys):
        out = gram_matrix(rows, ["a", "b"], "y", keys).orderBy(*keys).collect() if keys else gram_matrix(rows, ["a", "b"], "y").collect()
        return [[*r[: len(keys)], *np.round(r["ata"], 9), *np.round(r["atb"], 9)] for r in out]

    narrow = [found([]), found(["k"])]
    monkeypatch.setattr(nnls, "WIDE", 1)
    assert [found([]), found(["k"])] == narrow


def test_gram_of_two_hundred_columns(spark):
    rows = spark.range(300).select(*[F.sin(F.col("id") * (i + 1)).alias(f"c{i}") for i in range(200)], F.lit(1.0).alias("y"))
    ata = np.array(gram_matrix(rows, [f"c{i}" for i in range(200)], "y").first()["ata"]).reshape(200, 200)
    values = np.sin(np.arange(300)[:, None] * np.arange(1, 201)[None])
    assert np.allclose(ata, values.T @ values)
