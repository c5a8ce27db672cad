"""Queries for non-negative least squares."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from bandnet.catalog import sql as S
from bandnet.catalog.registry import query
from bandnet.catalog.tables import LINE_ROWS_SQL, LINEAR_FEATURES, line_rows, rounded, vectors
from bandnet.operators import gram_matrix, nnls_by_group, nnls_fit, unmix

PAIR = ["x0", "x2"]


def _two_by_two(prefix: str = "") -> tuple[str, str]:
    """The non-negative minimum of a two-variable quadratic, by cases."""
    a, b, c, p, q = (f"{prefix}{n}" for n in ("a", "b", "c", "p", "q"))
    det = f"({a} * {c} - {b} * {b})"
    first, second = f"(({c} * {p} - {b} * {q}) / {det})", f"(({a} * {q} - {b} * {p}) / {det})"
    inside = f"{first} >= 0 AND {second} >= 0"
    only_first, only_second = f"greatest({p} / {a}, 0.0)", f"greatest({q} / {c}, 0.0)"
    gain_first = f"{only_first} * {p}"
    gain_second = f"{only_second} * {q}"
    return (
        f"CASE WHEN {inside} THEN {first} WHEN {gain_first} >= {gain_second} THEN {only_first} ELSE 0.0 END",
        f"CASE WHEN {inside} THEN {second} WHEN {gain_first} >= {gain_second} THEN 0.0 ELSE {only_second} END",
    )


def _normal(u: str, v: str, y: str) -> str:
    return (
        f"sum({u} * {u}) AS a, sum({u} * {v}) AS b, sum({v} * {v}) AS c, sum({u} * {y}) AS p, sum({v} * {y}) AS q"
    )


@query(
    "gram_matrix",
    S.with_(
        [LINE_ROWS_SQL],
        "\nUNION ALL ".join(
            [f"SELECT {i * 4 + j}::int AS cell, {S.r(f'sum(x{i} * x{j}) / count(*)', 9)} AS value FROM rows" for i in range(4) for j in range(4)]
            + [f"SELECT {16 + i}::int AS cell, {S.r(f'sum(x{i} * target) / count(*)', 9)} AS value FROM rows" for i in range(4)]
        ),
    ),
)
def _gram_matrix(spark, folder):
    # a column of ones carries the row count along, for the mean
    rows = line_rows(spark, folder).withColumn("one", F.lit(1.0))
    sums = gram_matrix(rows, [*LINEAR_FEATURES, "one"], "target")
    cells = [F.col("ata")[i * 5 + j] for i in range(4) for j in range(4)] + [F.col("atb")[i] for i in range(4)]
    means = sums.select(F.array(*cells).alias("cells"), F.col("ata")[24].alias("n"))
    return means.select(F.posexplode("cells").alias("cell", "sum"), "n").select(
        "cell", rounded(F.col("sum") / F.col("n"), 9).alias("value")
    )


_BANDS_SQL = "bands AS MATERIALIZED (SELECT vec_id, label, unnest(range(64)) AS band, unnest(embedding)::double AS x FROM embeddings)"


def _band_columns(spark, folder):
    return vectors(spark, folder).select("id", "label", *[F.col("features")[i].cast("double").alias(f"x{i}") for i in range(64)])


@query(
    "gram_matrix_wide",
    S.with_(
        [_BANDS_SQL],
        f"SELECT (a.band * 64 + b.band)::int AS cell, {S.r('sum(a.x * b.x)', 6)} AS value FROM bands a JOIN bands b USING (vec_id) GROUP BY 1 "
        f"UNION ALL SELECT (4096 + band)::int AS cell, {S.r('sum(x * label)', 6)} AS value FROM bands GROUP BY 1",
    ),
)
def _gram_matrix_wide(spark, folder):
    sums = gram_matrix(_band_columns(spark, folder), [f"x{i}" for i in range(64)], "label")
    cells = sums.select(F.posexplode(F.concat("ata", "atb")).alias("cell", "value"))
    return cells.select("cell", rounded("value", 6).alias("value"))


@query(
    "gram_by_group_wide",
    S.with_(
        [_BANDS_SQL],
        f"SELECT a.label AS label, (a.band * 64 + b.band)::int AS cell, {S.r('sum(a.x * b.x)', 6)} AS value FROM bands a JOIN bands b USING (vec_id) GROUP BY 1, 2",
    ),
)
def _gram_by_group_wide(spark, folder):
    sums = gram_matrix(_band_columns(spark, folder).withColumn("target", F.lit(1.0)), [f"x{i}" for i in range(64)], "target", ["label"])
    return sums.select("label", F.posexplode("ata").alias("cell", "value")).select("label", "cell", rounded("value", 6).alias("value"))


_FIRST, _SECOND = _two_by_two()


@query(
    "nnls_two_var",
    S.with_(
        [LINE_ROWS_SQL, f"n AS (SELECT {_normal('x0', 'x2', 'target')} FROM rows)"],
        f"SELECT {S.r(_FIRST)} AS first, {S.r(_SECOND)} AS second FROM n",
    ),
)
def _nnls_two_var(spark, folder):
    found = nnls_fit(line_rows(spark, folder), PAIR, "target")
    return found.select(rounded(F.col("x")[0]).alias("first"), rounded(F.col("x")[1]).alias("second"))


@query(
    "nnls_by_group",
    S.with_(
        [LINE_ROWS_SQL, f"n AS (SELECT l_returnflag, {_normal('x0', 'x2', 'target')} FROM rows GROUP BY 1)"],
        f"SELECT l_returnflag, {S.r(_FIRST)} AS first, {S.r(_SECOND)} AS second FROM n",
    ),
)
def _nnls_by_group(spark, folder):
    found = nnls_by_group(line_rows(spark, folder), ["l_returnflag"], PAIR, "target")
    return found.select("l_returnflag", rounded(F.col("x")[0]).alias("first"), rounded(F.col("x")[1]).alias("second"))


@query(
    "nnls_many_groups",
    S.with_(
        [
            "rows AS MATERIALIZED (SELECT l_partkey, l_quantity / 50::double AS x0, l_discount * 10::double AS x2, "
            "l_discount * 5 - l_quantity / 100 + l_linenumber / 10 AS target FROM lineitem)",
            f"n AS (SELECT l_partkey, count(*) AS items, {_normal('x0', 'x2', 'target')} FROM rows GROUP BY 1)",
        ],
        f"SELECT l_partkey, {S.r(_FIRST, 5)} AS first, {S.r(_SECOND, 5)} AS second FROM n WHERE items >= 5 AND a * c - b * b > 1e-6 * a * c",
    ),
)
def _nnls_many_groups(spark, folder):
    """A system for every part, solved in batches of equal active sets; parts of few items or proportional columns aside."""
    rows = line_rows(spark, folder, F.col("l_partkey"))
    counted = rows.withColumn("one", F.lit(1.0))
    found = nnls_by_group(rows, ["l_partkey"], PAIR, "target")
    items = counted.groupBy("l_partkey").agg(F.sum("one").alias("items"))
    sound = F.col("ata")[0] * F.col("ata")[3] - F.col("ata")[1] * F.col("ata")[1] > 1e-6 * F.col("ata")[0] * F.col("ata")[3]
    kept = found.join(items, "l_partkey").where((F.col("items") >= 5) & sound)
    return kept.select("l_partkey", rounded(F.col("x")[0], 5).alias("first"), rounded(F.col("x")[1], 5).alias("second"))


@query(
    "nnls_optimality",
    S.with_([LINE_ROWS_SQL], "SELECT l_returnflag, 4::bigint AS conditions FROM rows GROUP BY l_returnflag"),
)
def _nnls_optimality(spark, folder):
    """How many of the four unknowns meet the optimality conditions, by group; all four must."""
    found = nnls_by_group(line_rows(spark, folder), ["l_returnflag"], LINEAR_FEATURES, "target")
    cells = found.select("l_returnflag", "ata", "atb", "x", F.posexplode("x").alias("i", "value"))
    row = F.slice(F.col("ata"), F.col("i") * 4 + 1, F.lit(4))
    slope = F.aggregate(F.zip_with(row, "x", lambda g, x: g * x), F.lit(0.0), lambda acc, v: acc + v) - F.col("atb")[F.col("i")]
    scale = F.array_max(F.transform("atb", F.abs)) * 1e-9
    met = F.when(F.col("value") > 0, F.abs(slope) <= scale).otherwise((F.col("value") == 0) & (slope >= -scale))
    return cells.groupBy("l_returnflag").agg(F.sum(met.cast("bigint")).alias("conditions"))


@query(
    "unmix",
    S.with_(
        [
            S.EMBEDDING_ROWS,
            S.LABEL_ROWS,
            "e AS MATERIALIZED (SELECT f, avg(v) FILTER (label = 0) AS e0, avg(v) FILTER (label = 1) AS e1 "
            "FROM x JOIN y ON x.id = y.id GROUP BY f)",
            "n AS MATERIALIZED (SELECT x.id, sum(e0 * e0) AS a, sum(e0 * e1) AS b, sum(e1 * e1) AS c, "
            "sum(e0 * v) AS p, sum(e1 * v) AS q FROM x JOIN e ON x.f = e.f GROUP BY x.id)",
        ],
        f"SELECT id, {S.r(_FIRST)} AS first, {S.r(_SECOND)} AS second FROM n",
    ),
)
def _unmix(spark, folder):
    df = vectors(spark, folder)
    # endmembers: the mean vector of two labels, two rows of 64 numbers
    means = (
        df.where("label in (0, 1)")
        .select("label", F.posexplode("features").alias("band", "v"))
        .groupBy("label", "band")
        .agg(F.avg(F.col("v").cast("double")).alias("v"))
        .collect()
    )
    members = np.zeros((2, 64))
    for row in means:
        members[row["label"], row["band"]] = row["v"]
    found = unmix(df, members)
    return found.select(
        "id", rounded(F.col("abundance")[0]).alias("first"), rounded(F.col("abundance")[1]).alias("second")
    )
