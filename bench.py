"""Benchmark: headline queries and one training workload, as one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Catalogue queries run over the given tables. The ``wide_*`` entries run over line items that
Spark turns into rows of 64 features: they show the cost of one pass of a network over a table,
and of training next to Spark's own perceptron on the one shape both can train.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from bandnet import DenseClassifier
from bandnet.catalog import CATALOG
from bandnet.operators import (
    BlockObjective,
    NetworkLoss,
    Topology,
    accuracy,
    formula_weights,
    minmax_fit,
    minmax_scale,
    network_column,
    stack_blocks,
    staged_blocks,
)
from bandnet.plans.applications import AUTOENCODER_LAYERS, CLASSIFIER_LAYERS

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
WIDTH = 64
HEADLINE = [
    "accuracy_by_label",
    "classifier_gradient",
    "autoencoder_gradient",
    "classify",
    "classify_native",
    "reconstruct",
    "logistic_gradient",
    "multinomial_gradient",
    "least_squares_gradient",
    "hinge_gradient",
    "logistic_gradient_blocks",
    "gd_steps_l2",
    "gd_network_steps",
    "lbfgs_least_squares",
    "lbfgs_ridge",
    "lbfgs_classifier_curve",
    "lbfgs_autoencoder_curve",
    "minmax_stats",
    "minmax_scaled_columns",
    "key_split_counts",
    "libsvm_unlabelled",
    "libsvm_roundtrip",
    "cube_to_pixels",
    "attach_labels",
    "fold_mse",
    "gram_matrix",
    "nnls_by_group",
    "unmix",
    "run_classification",
    "run_autoencoder",
]


def consume(df) -> None:
    """Run a query to the end without bringing its rows to the driver."""
    df.write.format("noop").mode("overwrite").save()


def timed(job) -> float:
    start = time.perf_counter()
    job()
    return time.perf_counter() - start


def wide_table(spark: SparkSession):
    """Line items as 64 features and 10 classes that depend on them."""
    items = spark.read.parquet(f"{FOLDER}/lineitem.parquet")
    base = ["l_quantity / 50", "l_extendedprice / 100000", "l_discount * 10", "l_tax * 10"]
    features = [F.expr(f"pmod({base[i % 4]} * {1 + i // 4}, 1.0D)") for i in range(WIDTH)]
    label = F.expr("cast(floor(l_quantity / 5.1) as double)")
    return items.repartition(int(CPUS)).select(F.array(*features).alias("features"), label.alias("label"))


def wide_timings(spark: SparkSession) -> tuple[dict[str, float], dict[str, float]]:
    """Times of preparing, passing over, training on and scoring the wide table."""
    seconds: dict[str, float] = {}
    wide = wide_table(spark).persist()
    rows = wide.count()
    bounds = minmax_fit(wide)
    seconds["wide_minmax_fit"] = timed(lambda: minmax_fit(wide))
    seconds["wide_minmax_scale"] = timed(lambda: consume(minmax_scale(wide, bounds)))
    topology = Topology.classifier([WIDTH, 32, 16, 10])
    weights = formula_weights(topology.weight_count)
    with staged_blocks(stack_blocks(wide, WIDTH, 256)) as blocks:
        seconds["wide_stack"] = timed(blocks.count)
        objective = BlockObjective(blocks, NetworkLoss(topology), WIDTH)
        objective.evaluate(weights)
        seconds["wide_evaluation"] = min(timed(lambda: objective.evaluate(weights)) for _ in range(3))
    column = network_column(wide, topology, weights, "features", decode=True)
    scored = wide.withColumn("prediction", column)
    consume(scored)
    seconds["wide_score"] = timed(lambda: accuracy(scored).collect())

    start, flat = 10, [WIDTH, 10]
    settings = {"layers": flat, "maxIter": start, "initialWeights": formula_weights(Topology.classifier(flat).weight_count)}
    seconds["wide_train_10"] = timed(lambda: DenseClassifier(blockSize=256, **settings).fit(wide))
    vectors = wide.select(array_to_vector("features").alias("features"), "label").persist()
    vectors.count()
    builtin = MultilayerPerceptronClassifier(
        layers=flat, maxIter=start, blockSize=256, initialWeights=list(settings["initialWeights"])
    )
    builtin_seconds = timed(lambda: builtin.fit(vectors))
    vectors.unpersist()
    wide.unpersist()
    figures = {
        "wide_rows": rows,
        "rows_times_weights_per_sec": rows * topology.weight_count / seconds["wide_evaluation"],
        "builtin_train_10_sec": builtin_seconds,
    }
    return seconds, figures


def shape_timings(spark: SparkSession) -> dict[str, float]:
    """One pass forward and back over line items for the layer sizes that the two jobs use."""
    figures: dict[str, float] = {}
    items = spark.read.parquet(f"{FOLDER}/lineitem.parquet").repartition(int(CPUS))
    base = [F.expr(sql).cast("float") for sql in ("l_quantity / 50", "l_extendedprice / 100000", "l_discount * 10", "l_tax * 10")]
    for name, topology in (
        ("classifier_shape", Topology.classifier(CLASSIFIER_LAYERS)),
        ("autoencoder_shape", Topology.autoencoder(AUTOENCODER_LAYERS)),
    ):
        rows = items.select(F.array(*[base[i % 4] for i in range(topology.inputs)]).alias("features"), (F.col("l_linenumber") % 7).cast("double").alias("label"))
        label = "label" if topology.target == "label" else None
        with staged_blocks(stack_blocks(rows, topology.inputs, 256, label=label)) as blocks:
            objective = BlockObjective(blocks, NetworkLoss(topology), topology.inputs)
            weights = formula_weights(topology.weight_count) / topology.inputs
            objective.evaluate(weights)
            figures[f"{name}_evaluation_sec"] = timed(lambda: objective.evaluate(weights))
    return figures


#: Queries of this round, timed beside the headline ones and not part of their sum
ADDED = [
    "sparse_logistic_sums", "sparse_gd_steps", "affine_table", "affine_table_sparse", "classifier_optimum", "run_classification_optimum",
    "run_autoencoder_optimum", "nnls_many_groups", "gd_minibatch_columns", "random_split_counts",
]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    consume(CATALOG["classify"].run(spark, FOLDER))  # start Python workers
    seconds = {name: timed(lambda: consume(CATALOG[name].run(spark, FOLDER))) for name in HEADLINE}
    wide, figures = wide_timings(spark)
    seconds.update(wide)
    figures |= shape_timings(spark)
    figures |= {f"{name}_sec": timed(lambda: consume(CATALOG[name].run(spark, FOLDER))) for name in ADDED}
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": {name: round(value, 3) for name, value in seconds.items()},
                "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
                "cpus": int(CPUS),
                "figures": {name: round(float(value), 3) for name, value in figures.items()},
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
