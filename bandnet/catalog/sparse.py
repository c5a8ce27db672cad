"""Queries on sparse rows and on weights held in tables: 100,000 columns, of which a row has a handful."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandnet.catalog import sql as S
from bandnet.catalog.registry import query
from bandnet.catalog.tables import rounded, table, vectors
from bandnet.operators import (
    BlockObjective, LogisticLoss, Topology, affine, fit_network, formula_weights, minimize_gd, simple_step, sparse_linear_sums, stack_blocks,
)
from bandnet.sources import read_libsvm, scratch_path, write_lines

WIDTH, STEPS, STEP = 100_000, 2, 64.0
_AT = f"(l_partkey * 7919 + l_suppkey * 104729 + l_linenumber) % {WIDTH}"
_AT_SQL = f"({_AT})::int"
# An order as a sparse row: an entry for each of its items, added up where two fall on one feature
_ENTRIES = (
    f"entries AS MATERIALIZED (SELECT l_orderkey AS id, {_AT_SQL} AS f, sum(l_quantity / 50::double) AS v FROM lineitem GROUP BY 1, 2), "
    "labels AS MATERIALIZED (SELECT l_orderkey AS id, max(CASE WHEN l_linestatus = 'F' THEN 1::double ELSE 0::double END) AS y FROM lineitem GROUP BY 1)"
)


def sparse_orders(spark, folder) -> DataFrame:
    """Orders as ``(id, features, label)`` with ``features`` a struct of indices and values."""
    items = table(spark, folder, "lineitem")
    entries = items.groupBy(F.col("l_orderkey").alias("id"), F.expr(_AT).cast("int").alias("f")).agg(
        F.sum(F.expr("l_quantity / 50D")).alias("v"), F.max(F.expr("CASE WHEN l_linestatus = 'F' THEN 1D ELSE 0D END")).alias("y")
    )
    rows = entries.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("f", "v"))).alias("e"), F.max("y").alias("label"))
    return rows.select("id", F.struct(F.col("e.f").alias("indices"), F.col("e.v").alias("values")).alias("features"), "label")


def _step_ctes(t: int) -> list[str]:
    """Slopes and mean gradient of the logistic loss at the weights ``w<t>``, where they are not zero."""
    return [
        f"m{t} AS MATERIALIZED (SELECT id, sum(e.v * w.v) AS m FROM entries e JOIN w{t} w ON e.f = w.f GROUP BY id)",
        f"s{t} AS MATERIALIZED (SELECT id, 1 / (1 + exp(-m)) - y AS s, ln(1 + exp(m)) - y * m AS loss FROM m{t} JOIN labels USING (id))",
        f"g{t} AS MATERIALIZED (SELECT f, sum(s * v) AS g FROM entries JOIN s{t} USING (id) GROUP BY f)",
    ]


_START = f"w0 AS MATERIALIZED (SELECT i AS f, {S.formula('i')} AS v FROM range({WIDTH}) t(i))"


@query(
    "sparse_logistic_sums",
    S.with_(
        [_ENTRIES, _START, *_step_ctes(0)],
        f"SELECT f::bigint AS position, {S.r('g', 9)} AS total FROM g0 "
        f"UNION ALL SELECT -1::bigint, {S.r('sum(loss)', 6)} FROM s0 UNION ALL SELECT -2::bigint, count(*)::double FROM s0",
    ),
)
def _sparse_logistic_sums(spark, folder):
    found = sparse_linear_sums(sparse_orders(spark, folder), LogisticLoss(), formula_weights(WIDTH), WIDTH)
    digits = F.when(F.col("position") == -1, F.round("total", 6)).otherwise(F.round("total", 9))
    return found.select("position", (digits + F.lit(0.0)).alias("total"))


def _descent_sql() -> str:
    ctes = [_ENTRIES, _START]
    for t in range(STEPS):
        ctes += _step_ctes(t)
        ctes.append(
            f"w{t + 1} AS MATERIALIZED (SELECT w.f, w.v - {STEP}::double / sqrt({t + 1}) * coalesce(g, 0) / (SELECT count(*) FROM s{t}) AS v "
            f"FROM w{t} w LEFT JOIN g{t} g ON w.f = g.f)"
        )
    return S.with_(ctes, f"SELECT f::bigint AS position, {S.r('v', 9)} AS value FROM w{STEPS}")


def _weight_rows(spark, weights) -> DataFrame:
    """A model's weights as a table; they are as many as the features, not as the rows."""
    rows = [(i, round(float(v), 9) + 0.0) for i, v in enumerate(weights)]
    return spark.createDataFrame(rows, "position long, value double")


@query("sparse_gd_steps", _descent_sql())
def _sparse_gd_steps(spark, folder):
    """Descent over sparse blocks, kept for the loop."""
    blocks = stack_blocks(sparse_orders(spark, folder), WIDTH, 512, sparse=True).persist()
    try:
        fit = minimize_gd(BlockObjective(blocks, LogisticLoss(), WIDTH), formula_weights(WIDTH), simple_step, STEP, STEPS, tol=0.0)
    finally:
        blocks.unpersist()
    return _weight_rows(spark, fit.weights)


@query("sparse_libsvm_gd_steps", _descent_sql())
def _sparse_libsvm_gd_steps(spark, folder):
    """The same through the trainer, from libsvm text whose vectors stay sparse from the file to the kernel."""
    path = scratch_path(spark, "libsvm")
    rows = sparse_orders(spark, folder)
    items = F.zip_with("features.indices", "features.values", lambda i, v: F.concat((i + 1).cast("string"), F.lit(":"), v.cast("string")))
    write_lines(rows.select(F.concat_ws(" ", F.col("label").cast("string"), items).alias("value")), path)
    fit = fit_network(
        read_libsvm(spark, path, WIDTH), Topology.regressor([WIDTH, 1]), loss=LogisticLoss(), solver="gd", max_iter=STEPS,
        step_size=STEP, tol=0.0, updater=simple_step, sparse=True, block_size=512, initial_weights=formula_weights(WIDTH),
    )
    return _weight_rows(spark, fit.weights)


NETWORK = [WIDTH, 3]


def _network_step_sql() -> str:
    """One step of a softmax layer on sparse rows, its label one of three."""
    cells = WIDTH * 3
    ctes = [
        _ENTRIES,
        "y AS MATERIALIZED (SELECT DISTINCT id, (id % 3)::int AS label FROM entries)",
        f"w AS MATERIALIZED (SELECT i // 3 AS f, i % 3 AS h, {S.formula('i')} AS v FROM range({cells}) t(i))",
        f"b AS MATERIALIZED (SELECT i AS h, {S.formula(f'i + {cells}')} AS v FROM range(3) t(i))",
        "z AS MATERIALIZED (SELECT id, w.h, sum(e.v * w.v) + any_value(b.v) AS z FROM entries e JOIN w ON e.f = w.f JOIN b ON b.h = w.h GROUP BY id, w.h)",
        "p AS MATERIALIZED (SELECT id, h, exp(z) / sum(exp(z)) OVER (PARTITION BY id) - (CASE WHEN label = h THEN 1 ELSE 0 END) AS d FROM z JOIN y USING (id))",
        "g AS MATERIALIZED (SELECT f, h, sum(d * v) / (SELECT count(*) FROM y) AS g FROM entries JOIN p USING (id) GROUP BY f, h)",
        "gb AS MATERIALIZED (SELECT h, sum(d) / (SELECT count(*) FROM y) AS g FROM p GROUP BY h)",
    ]
    return S.with_(
        ctes,
        f"SELECT (f * 3 + h)::bigint AS position, {S.r(f'v - {STEP}::double * coalesce(g, 0)', 9)} AS value FROM w LEFT JOIN g USING (f, h) "
        f"UNION ALL SELECT ({cells} + h)::bigint, {S.r(f'v - {STEP}::double * g', 9)} FROM b JOIN gb USING (h)",
    )


@query("sparse_network_step", _network_step_sql())
def _sparse_network_step(spark, folder):
    """A network whose first layer meets sparse rows: products of compressed rows and dense matrices."""
    topology = Topology.classifier(NETWORK)
    rows = sparse_orders(spark, folder).withColumn("label", F.col("id") % 3)
    fit = fit_network(
        rows, topology, solver="gd", max_iter=1, step_size=STEP, tol=0.0, sparse=True, block_size=512,
        initial_weights=formula_weights(topology.weight_count),
    )
    return _weight_rows(spark, fit.weights)


def formula_layer(spark, inputs: int, outputs: int) -> DataFrame:
    """A layer's formula weights as a table that Spark makes, the bias at input -1."""
    at, cells = F.col("id"), inputs * outputs
    value = (at * 7919 + 13) % 1000 / F.lit(1000.0) - 0.5
    source = F.when(at < cells, F.floor(at / outputs)).otherwise(F.lit(-1))
    return spark.range(cells + outputs).select(source.alias("input"), (at % outputs).alias("output"), value.alias("value"))


@query("affine_table", S.with_([S.EMBEDDING_ROWS, *S.weight_ctes([64, 10]), *S.forward_ctes([64, 10], top="identity")], f"SELECT id, f::int AS output, {S.r('v', 6)} AS value FROM a1"))
def _affine_table(spark, folder):
    found = affine(vectors(spark, folder), formula_layer(spark, 64, 10))
    return found.select("id", F.posexplode("output").alias("output", "value")).select("id", "output", rounded("value").alias("value"))


_LAYER_CELLS = WIDTH * 3


@query(
    "affine_table_sparse",
    S.with_(
        [
            _ENTRIES,
            f"w AS MATERIALIZED (SELECT i // 3 AS f, i % 3 AS h, {S.formula('i')} AS v FROM range({_LAYER_CELLS}) t(i))",
            f"b AS MATERIALIZED (SELECT i AS h, {S.formula(f'i + {_LAYER_CELLS}')} AS v FROM range(3) t(i))",
        ],
        f"SELECT id, w.h::int AS output, {S.r('sum(e.v * w.v) + any_value(b.v)', 6)} AS value "
        "FROM entries e JOIN w ON e.f = w.f JOIN b ON b.h = w.h GROUP BY id, w.h",
    ),
)
def _affine_table_sparse(spark, folder):
    """A layer of 300,000 weights, of which a row meets three for each of its entries."""
    found = affine(sparse_orders(spark, folder), formula_layer(spark, WIDTH, 3))
    return found.select("id", F.posexplode("output").alias("output", "value")).select("id", "output", rounded("value").alias("value"))
