"""Queries for layers, forward passes, losses and back-propagated gradients."""

from __future__ import annotations

from pyspark.sql import functions as F

from bandnet.catalog import sql as S
from bandnet.catalog.registry import query
from bandnet.catalog.tables import rounded, vectors
from bandnet.functions import (
    affine,
    argmax,
    cross_entropy,
    elementwise_pair,
    network_output,
    relu,
    relu_grad,
    sigmoid,
    sigmoid_grad,
    softmax,
)
from bandnet.operators import (
    RELU,
    SIGMOID,
    Affine,
    Elementwise,
    SigmoidSquaredError,
    Topology,
    accuracy_by_label,
    encode,
    formula_weights,
    forward,
    forward_all,
    gradient_frame,
    loss_frame,
    minmax_fit,
    minmax_scale,
)

CLASSIFIER = [64, 16, 10]
AUTOENCODER = [64, 8, 64]
SIGMOID_SIZES = [64, 8, 10]


def sigmoid_network() -> Topology:
    """A sigmoid hidden layer under a sigmoid output scored by squared error."""
    first, second = (Affine(a, b) for a, b in zip(SIGMOID_SIZES, SIGMOID_SIZES[1:]))
    return Topology((first, Elementwise(SIGMOID), second, SigmoidSquaredError()))


def weights_of(topology: Topology):
    return formula_weights(topology.weight_count)


def _long(df, column, index="unit"):
    """An array column as ``(id, <index>, value)``."""
    return df.select("id", F.posexplode(column).alias(index, "value")).select("id", index, rounded("value").alias("value"))


def _first_layer(spark, folder):
    topology = Topology.classifier(CLASSIFIER)
    _, matrix, bias = next(topology.layer_weights(weights_of(topology)))
    return vectors(spark, folder).select("id", affine("features", matrix.T, bias).alias("z"))


def _layer_sql(expr: str) -> str:
    return S.with_(
        [S.EMBEDDING_ROWS, *S.weight_ctes(CLASSIFIER), *S.forward_ctes(CLASSIFIER[:2], top="identity")],
        f"SELECT id, f::int AS unit, {S.r(expr)} AS value FROM a1",
    )


@query("affine_layer", _layer_sql("v"))
def _affine_layer(spark, folder):
    return _long(_first_layer(spark, folder), "z")


@query("relu_layer", _layer_sql("greatest(v, 0.0)"))
def _relu_layer(spark, folder):
    return _long(_first_layer(spark, folder), relu("z"))


@query("sigmoid_layer", _layer_sql("1.0 / (1.0 + exp(-v))"))
def _sigmoid_layer(spark, folder):
    return _long(_first_layer(spark, folder), sigmoid("z"))


@query("relu_slopes", _layer_sql("CASE WHEN v > 0 THEN 1.0::double ELSE 0.0::double END"))
def _relu_slopes(spark, folder):
    return _long(_first_layer(spark, folder), relu_grad(relu("z")))


@query("sigmoid_slopes", _layer_sql("(1.0 - 1.0 / (1.0 + exp(-v))) / (1.0 + exp(-v))"))
def _sigmoid_slopes(spark, folder):
    return _long(_first_layer(spark, folder), sigmoid_grad(sigmoid("z")))


@query("elementwise_product", _layer_sql("greatest(v, 0.0) * v"))
def _elementwise_product(spark, folder):
    return _long(_first_layer(spark, folder), elementwise_pair(relu("z"), "z", lambda a, b: a * b))


@query(
    "softmax_probs",
    S.with_(
        [S.EMBEDDING_ROWS, *S.weight_ctes(CLASSIFIER), *S.forward_ctes(CLASSIFIER[:2])],
        f"SELECT id, f::int AS unit, {S.r('v')} AS value FROM a1",
    ),
)
def _softmax_probs(spark, folder):
    return _long(_first_layer(spark, folder), softmax("z"))


_CLASSIFY = [S.EMBEDDING_ROWS, S.LABEL_ROWS, *S.weight_ctes(CLASSIFIER), *S.forward_ctes(CLASSIFIER)]
_RECONSTRUCT = [
    S.EMBEDDING_ROWS,
    *S.weight_ctes(AUTOENCODER),
    *S.forward_ctes(AUTOENCODER, top="identity"),
]


@query("forward_hidden", S.with_(_CLASSIFY, f"SELECT id, f::int AS unit, {S.r('v')} AS value FROM a1"))
def _forward_hidden(spark, folder):
    topology = Topology.classifier(CLASSIFIER)
    scored = forward_all(vectors(spark, folder), topology, weights_of(topology))
    # layers: affine, relu, affine, softmax
    return _long(scored.withColumn("hidden", F.col("outputs")[1]), "hidden")


@query("encode_codes", S.with_(_RECONSTRUCT, f"SELECT id, f::int AS unit, {S.r('v')} AS value FROM a1"))
def _encode_codes(spark, folder):
    topology = Topology.autoencoder(AUTOENCODER)
    return _long(encode(vectors(spark, folder), topology, weights_of(topology)), "code")


_PREDICTED = (
    "best AS (SELECT id, arg_max(f, v)::double AS prediction, max(v) AS top FROM a2 GROUP BY id)"
)
_CLASSIFY_SQL = S.with_([*_CLASSIFY, _PREDICTED], f"SELECT id, prediction, {S.r('top')} AS top FROM best")


@query("classify", _CLASSIFY_SQL)
def _classify(spark, folder):
    topology = Topology.classifier(CLASSIFIER)
    scored = forward(vectors(spark, folder), topology, weights_of(topology))
    return scored.select("id", argmax("output").alias("prediction"), rounded(F.array_max("output")).alias("top"))


@query("classify_native", _CLASSIFY_SQL)
def _classify_native(spark, folder):
    # the same pass as one column expression, without a Python worker
    topology = Topology.classifier(CLASSIFIER)
    output = network_output("features", topology, weights_of(topology))
    scored = vectors(spark, folder).select("id", output.alias("output"))
    return scored.select("id", argmax("output").alias("prediction"), rounded(F.array_max("output")).alias("top"))


@query("reconstruct", S.with_(_RECONSTRUCT, f"SELECT id, f::int AS band, {S.r('v')} AS value FROM a2"))
def _reconstruct(spark, folder):
    topology = Topology.autoencoder(AUTOENCODER)
    return _long(forward(vectors(spark, folder), topology, weights_of(topology)), "output", "band")


@query(
    "xent_loss",
    S.with_(
        _CLASSIFY,
        f"SELECT {S.r('-sum(logp) / count(*)', 9)} AS loss, count(*) AS units FROM a2 JOIN y ON a2.id = y.id AND a2.f = y.label",
    ),
)
def _xent_loss(spark, folder):
    topology = Topology.classifier(CLASSIFIER)
    found = loss_frame(vectors(spark, folder), topology, weights_of(topology))
    return found.select(rounded("loss", 9).alias("loss"), "units")


@query(
    "xent_by_label",
    S.with_(
        _CLASSIFY,
        f"SELECT label, {S.r('-sum(logp) / count(*)', 9)} AS loss FROM a2 JOIN y ON a2.id = y.id AND a2.f = y.label GROUP BY label",
    ),
)
def _xent_by_label(spark, folder):
    topology = Topology.classifier(CLASSIFIER)
    scored = forward(vectors(spark, folder), topology, weights_of(topology))
    losses = scored.select("label", cross_entropy("output", "label").alias("loss"))
    return losses.groupBy("label").agg(rounded(F.avg("loss"), 9).alias("loss"))


_SSE = "sum((a.v - x.v) * (a.v - x.v))"


@query(
    "sse_loss",
    S.with_(
        _RECONSTRUCT,
        f"SELECT {S.r(f'{_SSE} / (2 * count(*))', 9)} AS loss, (count(*) // 64)::bigint AS units "
        "FROM a2 a JOIN x ON a.id = x.id AND a.f = x.f",
    ),
)
def _sse_loss(spark, folder):
    topology = Topology.autoencoder(AUTOENCODER)
    return loss_frame(vectors(spark, folder), topology, weights_of(topology)).select(rounded("loss", 9).alias("loss"), "units")


_SIGMOID = [
    S.EMBEDDING_ROWS,
    S.LABEL_ROWS,
    *S.weight_ctes(SIGMOID_SIZES),
    *S.forward_ctes(SIGMOID_SIZES, hidden="sigmoid", top="sigmoid"),
    S.error_cte(SIGMOID_SIZES),
]


@query(
    "sigmoid_sse_loss",
    S.with_(_SIGMOID, f"SELECT {S.r(f'sum(v * v) / 2 / {S.ROWS}', 9)} AS loss, {S.ROWS} AS units FROM err"),
)
def _sigmoid_sse_loss(spark, folder):
    topology = sigmoid_network()
    found = loss_frame(vectors(spark, folder), topology, weights_of(topology))
    return found.select(rounded("loss", 9).alias("loss"), "units")


_TARGET = [
    S.EMBEDDING_ROWS,
    S.REVERSED_ROWS,
    *S.weight_ctes(AUTOENCODER),
    *S.forward_ctes(AUTOENCODER, top="identity"),
    S.error_cte(AUTOENCODER, target="column"),
]


@query(
    "target_gradient",
    S.with_([*_TARGET, *S.gradient_ctes(AUTOENCODER, top="identity")], S.layered_select(AUTOENCODER, "gw", "gb", "gradient")),
)
def _target_gradient(spark, folder):
    topology = Topology.regressor(AUTOENCODER)
    rows = vectors(spark, folder).withColumn("target", F.reverse("features"))
    found = gradient_frame(rows, topology, weights_of(topology))
    return found.select("layer", "input", "output", rounded("gradient", 9).alias("gradient"))


def _gradient(spark, folder, topology):
    found = gradient_frame(vectors(spark, folder), topology, weights_of(topology))
    return found.select("layer", "input", "output", rounded("gradient", 9).alias("gradient"))


@query(
    "classifier_gradient",
    S.with_(
        [*_CLASSIFY, S.error_cte(CLASSIFIER), *S.gradient_ctes(CLASSIFIER)],
        S.layered_select(CLASSIFIER, "gw", "gb", "gradient"),
    ),
)
def _classifier_gradient(spark, folder):
    return _gradient(spark, folder, Topology.classifier(CLASSIFIER))


@query(
    "autoencoder_gradient",
    S.with_(
        [*_RECONSTRUCT, S.error_cte(AUTOENCODER, target="input"), *S.gradient_ctes(AUTOENCODER, top="identity")],
        S.layered_select(AUTOENCODER, "gw", "gb", "gradient"),
    ),
)
def _autoencoder_gradient(spark, folder):
    return _gradient(spark, folder, Topology.autoencoder(AUTOENCODER))


@query(
    "sigmoid_net_gradient",
    S.with_(
        [*_SIGMOID, *S.gradient_ctes(SIGMOID_SIZES, hidden="sigmoid", top="sigmoid")],
        S.layered_select(SIGMOID_SIZES, "gw", "gb", "gradient"),
    ),
)
def _sigmoid_net_gradient(spark, folder):
    return _gradient(spark, folder, sigmoid_network())


_SCALED_CLASSIFY = [S.SCALED_ROWS, S.LABEL_ROWS, *S.weight_ctes(CLASSIFIER), *S.forward_ctes(CLASSIFIER), _PREDICTED]
ACCURACY_SQL = S.with_(
    _SCALED_CLASSIFY,
    f"SELECT label, {S.r('avg(CASE WHEN prediction = label THEN 1.0::double ELSE 0.0::double END)')} AS accuracy, count(*) AS n "
    "FROM best JOIN y ON best.id = y.id GROUP BY label",
)


@query("accuracy_by_label", ACCURACY_SQL)
def accuracy_of_formula_network(spark, folder):
    """Scale, run the formula-weighted classifier, and compare with the labels."""
    df = vectors(spark, folder)
    topology = Topology.classifier(CLASSIFIER, RELU)
    scored = forward(minmax_scale(df, minmax_fit(df)), topology, weights_of(topology))
    found = accuracy_by_label(scored.withColumn("prediction", argmax("output")))
    return found.select("label", rounded("accuracy").alias("accuracy"), "n")
