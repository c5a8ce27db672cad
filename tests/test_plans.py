"""The physical plans: what is read, what is shuffled, what never happens."""

import pytest

from bandnet.catalog import CATALOG
from bandnet.catalog.tables import line_rows, vectors
from bandnet.operators import LogisticLoss, Topology, formula_weights, gradient_frame, linear_sums, network_column, split_by_key, stack_blocks


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


LAZY = [n for n in CATALOG if not n.startswith(("lbfgs", "gd_", "run_", "save_", "pixels_csv", "libsvm_roundtrip"))]


@pytest.mark.parametrize("name", LAZY)
def test_no_query_pairs_rows_freely(spark, small, name):
    text = plan(CATALOG[name].run(spark, small))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_only_needed_columns_are_read(spark, small):
    text = plan(gradient_frame(vectors(spark, small), Topology.classifier([64, 10]), formula_weights(650)))
    assert "ReadSchema: struct<embedding:array<float>,label:int>" in text
    rows = line_rows(spark, small).select("x0", "x1", "x2", "x3", "flag").withColumnRenamed("flag", "y")
    text = plan(linear_sums(rows, 4, LogisticLoss(), [0.0] * 4))
    assert "l_orderkey" not in text and "l_shipdate" not in text
    assert text.count("Exchange") == 1 and "Python" not in text


def test_preparation_does_not_shuffle(spark, small):
    df = split_by_key(vectors(spark, small), "id", [0.8, 0.2]).where("split = 0")
    text = plan(stack_blocks(df, 64))
    assert "Exchange" not in text and text.count("MapInArrow") == 1


def test_scoring_sends_only_features_to_python(spark, small):
    df = vectors(spark, small)
    scored = df.withColumn("p", network_column(df, Topology.classifier([64, 10]), formula_weights(650), "features"))
    text = plan(scored)
    assert text.count("ArrowEvalPython") == 1 and "Exchange" not in text
    assert "ArrowEvalPython" not in plan(scored.select("id"))
