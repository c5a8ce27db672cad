"""Queries that check training where the optimum is known in closed form.

A softmax layer on one-hot groups can fit any class shares, so at the optimum its probabilities are the shares of the
classes in each group. An autoencoder with one hidden unit that stays active is a line through the centre of the data, so
at the optimum its error is the smaller eigenvalue of the covariance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandnet.catalog import sql as S
from bandnet.catalog.registry import query
from bandnet.catalog.tables import rounded, table
from bandnet.functions import one_hot
from bandnet.models import DenseAutoencoder, DenseClassifier
from bandnet.operators import split_bounds
from bandnet.plans import run_autoencoder, run_classification

GROUPS, CLASSES = 7, 3
# Most items of an order have the label that follows their line number, the others one that follows their supplier
_LABEL = "(CASE WHEN l_orderkey % 10 < 6 THEN (l_linenumber - 1) % 3 ELSE l_suppkey % 3 END)"
_KEY = "l_orderkey::varchar || '-' || l_linenumber::varchar"
_ITEMS = f"items AS MATERIALIZED (SELECT (l_linenumber - 1)::int AS g, {_LABEL}::int AS label, {_KEY} AS line FROM lineitem)"
_SHARES = (
    "counts AS (SELECT g, label, count(*) AS n FROM {rows} GROUP BY 1, 2), "
    f"cells AS (SELECT g, label FROM (SELECT DISTINCT g FROM counts), (SELECT unnest(range({CLASSES}))::int AS label)), "
    "shares AS MATERIALIZED (SELECT g, label, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY g) AS share FROM cells LEFT JOIN counts USING (g, label))"
)
_TRAIN = f"('0x' || substr(md5('split:' || line), 1, 15))::bigint < {split_bounds([0.8, 0.2])[0]}"


def grouped_items(spark, folder) -> DataFrame:
    """Line items as ``(line, g, features, label)``, the features being the one-hot line number."""
    items = table(spark, folder, "lineitem").select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("line"),
        (F.col("l_linenumber") - 1).cast("int").alias("g"),
        F.expr(_LABEL).cast("int").alias("label"),
    )
    return items.withColumn("features", one_hot("g", GROUPS))


@query("classifier_optimum", S.with_([_ITEMS, _SHARES.format(rows="items")], f"SELECT g, label, {S.r('share', 4)} AS probability FROM shares"))
def _classifier_optimum(spark, folder):
    rows = grouped_items(spark, folder)
    model = DenseClassifier(layers=[GROUPS, CLASSES], maxIter=200, tol=1e-13, blockSize=512, seed=3).fit(rows)
    chances = model.transform(rows.groupBy("g").agg(F.first("features").alias("features")))
    return chances.select("g", F.posexplode("probability").alias("label", "p")).select("g", "label", rounded("p", 4).alias("probability"))


@query(
    "classifier_hidden_optimum",
    S.with_([_ITEMS, _SHARES.format(rows="items")], f"SELECT {S.r('-sum(n * ln(share)) / sum(n)', 4)} AS loss FROM counts JOIN shares USING (g, label)"),
)
def _classifier_hidden_optimum(spark, folder):
    """A hidden layer cannot do better than the shares, and with enough units no worse: its last loss is their entropy."""
    model = DenseClassifier(layers=[GROUPS, 16, CLASSES], maxIter=300, tol=1e-13, blockSize=512, seed=5).fit(grouped_items(spark, folder))
    return model.summary.orderBy(F.desc("iteration")).limit(1).select(rounded("loss", 4).alias("loss"))


@query(
    "run_classification_optimum",
    S.with_(
        [
            _ITEMS, f"train AS MATERIALIZED (SELECT * FROM items WHERE {_TRAIN})", _SHARES.format(rows="train"),
            "best AS (SELECT g, arg_max(label, share) AS predicted FROM shares GROUP BY g)",
        ],
        f"SELECT {S.r('avg(CASE WHEN label = predicted THEN 1::double ELSE 0::double END)')} AS accuracy, count(*) AS n FROM items JOIN best USING (g) WHERE NOT ({_TRAIN})",
    ),
)
def _run_classification_optimum(spark, folder):
    """The whole job; its split, its scaling and its prediction all show in the accuracy on the rows kept back."""
    result = run_classification(spark, grouped_items(spark, folder), 0.8, 60, layers=[GROUPS, CLASSES], key="line")
    return result.metrics.select(rounded("accuracy").alias("accuracy"), "n")


_PRICES = f"prices AS MATERIALIZED (SELECT l_quantity::double AS a, l_extendedprice::double AS b, {_KEY} AS line FROM lineitem)"
_SCALED = (
    "scaled AS MATERIALIZED (SELECT (a - (SELECT min(a) FROM prices)) / (SELECT max(a) - min(a) FROM prices) AS a, "
    "(b - (SELECT min(b) FROM prices)) / (SELECT max(b) - min(b) FROM prices) AS b, line FROM prices)"
)
_MOMENTS = (
    "moments AS (SELECT avg(a) AS ma, avg(b) AS mb, var_pop(a) AS saa, var_pop(b) AS sbb, covar_pop(a, b) AS sab FROM {rows}), "
    "axes AS MATERIALIZED (SELECT *, (saa + sbb) / 2 - sqrt((saa - sbb) * (saa - sbb) / 4 + sab * sab) AS small FROM moments)"
)
# Weights whose hidden unit is active for every row: the sum of the two features, then half of it for either
_ACTIVE = [1.0, 1.0, 1.0, 0.5, 0.5, 0.0, 0.0]


def priced_items(spark, folder) -> DataFrame:
    """Line items as ``(line, features)``, quantity and price."""
    return table(spark, folder, "lineitem").select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("line"),
        F.array(F.col("l_quantity").cast("double"), F.col("l_extendedprice").cast("double")).alias("features"),
    )


@query(
    "autoencoder_optimum",
    S.with_([_PRICES, _SCALED, _MOMENTS.format(rows="scaled")], f"SELECT {S.r('small / 4', 6)} AS loss FROM axes"),
)
def _autoencoder_optimum(spark, folder):
    """The last reported loss: half the squared error for each of two outputs."""
    rows = priced_items(spark, folder).withColumn("in_train", F.lit(True))
    estimator = DenseAutoencoder(layers=[2, 1, 2], maxIter=300, tol=1e-13, blockSize=512, initialWeights=_ACTIVE)
    model, _ = estimator.fit_part(rows, "in_train", "all")
    return model.summary.orderBy(F.desc("iteration")).limit(1).select(rounded("loss", 6).alias("loss"))


_FOLD = "(('0x' || substr(md5('fold:' || line), 1, 15))::bigint % 4)::int"
# What is left of a row beside the line: its part along the other axis, which is (sab, small - saa) as long as it is
_REST = "((a - ma) * sab + (b - mb) * (small - saa))"


@query(
    "run_autoencoder_optimum",
    S.with_(
        [
            _PRICES, _SCALED, f"train AS MATERIALIZED (SELECT * FROM scaled WHERE {_TRAIN})", _MOMENTS.format(rows="train"),
            f"rest AS (SELECT {_FOLD} AS fold, {_REST} * {_REST} / (sab * sab + (small - saa) * (small - saa)) AS r FROM scaled, axes WHERE NOT ({_TRAIN}))",
            "folds AS (SELECT fold, avg(r) / 2 AS mse FROM rest GROUP BY fold)",
        ],
        f"SELECT {S.r('avg(mse)', 6)} AS mse FROM folds",
    ),
)
def _run_autoencoder_optimum(spark, folder):
    """The whole job: split, scaling, training, and the mean error over four folds of the rows kept back."""
    result = run_autoencoder(
        spark, priced_items(spark, folder), 0.8, 300, layers=[2, 1, 2], key="line", tol=1e-13, initialWeights=_ACTIVE
    )
    return result.metrics.select(rounded("mse", 6).alias("mse"))
