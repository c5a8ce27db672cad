"""Queries for loading, scaling, splitting, encoding and packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from bandnet.catalog import sql as S
from bandnet.catalog.registry import query
from bandnet.catalog.tables import rounded, table, vectors
from bandnet.functions import argmax, one_hot
from bandnet.operators import (
    k_folds,
    labeled_rows,
    minmax_columns,
    minmax_fit,
    minmax_scale,
    minmax_stats,
    random_split,
    split_bounds,
    split_by_key,
    split_rows,
    stack_blocks,
    unstack_blocks,
)
from bandnet.sources import (
    attach_labels,
    csv_to_libsvm,
    cube_cells,
    cube_to_pixels,
    features_to_libsvm,
    pixels_to_cube,
    read_libsvm,
    read_pixel_csv,
    scratch_path,
    write_lines,
    write_pixels_csv,
)


@query(
    "minmax_stats",
    S.with_(
        [S.EMBEDDING_ROWS],
        f"SELECT f::int AS band, {S.r('min(v)')} AS low, {S.r('max(v)')} AS high FROM x GROUP BY f",
    ),
)
def _minmax_stats(spark, folder):
    return minmax_stats(vectors(spark, folder)).select("band", rounded("low").alias("low"), rounded("high").alias("high"))


@query(
    "minmax_scaled",
    S.with_([S.SCALED_ROWS], f"SELECT id, f::int AS band, {S.r('v')} AS value FROM x"),
)
def _minmax_scaled(spark, folder):
    df = vectors(spark, folder)
    scaled = minmax_scale(df, minmax_fit(df))
    return scaled.select("id", F.posexplode("features").alias("band", "value")).select(
        "id", "band", rounded("value").alias("value")
    )


_SCALED_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "minmax_scaled_columns",
    "WITH b AS (SELECT "
    + ", ".join(f"min({c}) AS lo{i}, max({c}) AS hi{i}" for i, c in enumerate(_SCALED_COLUMNS))
    + " FROM lineitem) SELECT l_orderkey, l_linenumber, "
    + ", ".join(f"{S.r(f'({c} - lo{i}) / (hi{i} - lo{i})')} AS {c}" for i, c in enumerate(_SCALED_COLUMNS))
    + " FROM lineitem, b",
)
def _minmax_scaled_columns(spark, folder):
    items = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", *_SCALED_COLUMNS)
    scaled = minmax_columns(items, _SCALED_COLUMNS)
    return scaled.select("l_orderkey", "l_linenumber", *[rounded(c).alias(c) for c in _SCALED_COLUMNS])


def _bucket(salt: str, key: str = "vec_id") -> str:
    return f"('0x' || substr(md5('{salt}:' || {key}::varchar), 1, 15))::bigint"


@query(
    "key_split_counts",
    f"SELECT (CASE WHEN {_bucket('split')} < {split_bounds([0.8, 0.2])[0]} THEN 0 ELSE 1 END)::int AS split, count(*) AS n, "
    "sum(vec_id)::bigint AS id_sum FROM embeddings GROUP BY 1",
)
def _key_split_counts(spark, folder):
    parts = split_by_key(vectors(spark, folder).select("id"), "id", [0.8, 0.2])
    return parts.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("id_sum"))


@query(
    "fold_counts",
    f"SELECT ({_bucket('fold')} % 4)::int AS fold, count(*) AS n, sum(vec_id)::bigint AS id_sum FROM embeddings "
    f"WHERE {_bucket('split')} >= {split_bounds([0.8, 0.2])[0]} GROUP BY 1",
)
def _fold_counts(spark, folder):
    parts = split_by_key(vectors(spark, folder).select("id"), "id", [0.8, 0.2])
    folds = k_folds(parts.where("split = 1"), "id", 4)
    return folds.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("id_sum"))


@query(
    "key_split_tiny_part",
    f"SELECT (CASE WHEN {_bucket('split', 'l_orderkey')} < {split_bounds([0.9996, 0.0004])[0]} THEN 0 ELSE 1 END)::int AS split, "
    "count(*) AS n, sum(l_orderkey)::bigint AS key_sum FROM lineitem GROUP BY 1",
)
def _key_split_tiny_part(spark, folder):
    parts = split_by_key(table(spark, folder, "lineitem").select("l_orderkey"), "l_orderkey", [0.9996, 0.0004])
    return parts.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("key_sum"))


@query(
    "many_folds",
    f"SELECT ({_bucket('fold', 'event_id')} % 2000)::int AS fold, count(*) AS n FROM events GROUP BY 1",
)
def _many_folds(spark, folder):
    return k_folds(table(spark, folder, "events").select("event_id"), "event_id", 2000).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


@query("random_split_cover", "SELECT count(*) AS n, sum(vec_id)::bigint AS id_sum FROM embeddings")
def _random_split_cover(spark, folder):
    # the parts of a random split hold every row exactly once
    train, test = random_split(vectors(spark, folder).select("id"), [0.8, 0.2])
    return train.unionByName(test).agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("id_sum"))


_ROW_DIGEST = "md5(vec_id::varchar || chr(31) || label::varchar)"


@query(
    "random_split_counts",
    f"SELECT (CASE WHEN ('0x' || substr(md5('rows-1234:' || {_ROW_DIGEST} || ':1'), 1, 15))::bigint < {split_bounds([0.8, 0.2])[0]} "
    "THEN 0 ELSE 1 END)::int AS part, count(*) AS n, sum(vec_id)::bigint AS id_sum FROM embeddings GROUP BY 1",
)
def _random_split_counts(spark, folder):
    parts = random_split(vectors(spark, folder).select("id", "label"), [0.8, 0.2])
    marked = [p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)]
    return marked[0].unionByName(marked[1]).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("id_sum"))


# Line items without their keys: many are alike and are told apart by their number
_ALIKE = "l_returnflag || chr(31) || l_linestatus || chr(31) || l_linenumber::varchar"


@query(
    "random_split_repeated_rows",
    f"WITH rows AS (SELECT *, md5({_ALIKE}) AS digest FROM lineitem), "
    "numbered AS (SELECT *, row_number() OVER (PARTITION BY digest) AS place FROM rows) "
    "SELECT l_returnflag, l_linestatus, l_linenumber, "
    f"(CASE WHEN ('0x' || substr(md5('rows-7:' || digest || ':' || place), 1, 15))::bigint < {split_bounds([0.5, 0.5])[0]} THEN 0 ELSE 1 END)::int AS split, "
    "count(*) AS n FROM numbered GROUP BY ALL",
)
def _random_split_repeated_rows(spark, folder):
    kind = ["l_returnflag", "l_linestatus", "l_linenumber"]
    return split_rows(table(spark, folder, "lineitem").select(*kind), [0.5, 0.5], 7).groupBy(*kind, "split").agg(F.count(F.lit(1)).alias("n"))


@query(
    "labeled_rows",
    "SELECT label::double AS label, count(*) AS n, "
    f"{S.r('sum(list_sum(embedding::double[]))')} AS total FROM embeddings GROUP BY label",
)
def _labeled_rows(spark, folder):
    total = F.aggregate(F.col("features").cast("array<double>"), F.lit(0.0), lambda acc, v: acc + v)
    rows = labeled_rows(vectors(spark, folder)).withColumn("total", total)
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("total")).alias("total"))


@query(
    "one_hot_labels",
    "SELECT vec_id AS id, k::int AS slot, (CASE WHEN k = label THEN 1 ELSE 0 END)::double AS value "
    "FROM embeddings, range(10) t(k)",
)
def _one_hot_labels(spark, folder):
    rows = vectors(spark, folder).select("id", F.posexplode(one_hot("label", 10)).alias("slot", "value"))
    return rows


@query(
    "argmax_band",
    "SELECT vec_id AS id, (list_position(embedding, list_max(embedding)) - 1)::double AS band FROM embeddings",
)
def _argmax_band(spark, folder):
    return vectors(spark, folder).select("id", argmax("features").alias("band"))


@query(
    "block_sizes",
    "SELECT count(*) AS n, 64::int AS largest, (count(*) * 64)::bigint AS feature_values, count(*) AS label_values FROM embeddings",
)
def _block_sizes(spark, folder):
    blocks = stack_blocks(vectors(spark, folder), 64, block_size=64)
    return blocks.agg(
        F.sum("n").alias("n"),
        F.max("n").alias("largest"),
        # 32-bit features, 64-bit labels
        (F.sum(F.length("x")) / 4).cast("bigint").alias("feature_values"),
        (F.sum(F.length("y")) / 8).cast("bigint").alias("label_values"),
    )


@query(
    "unstack_roundtrip",
    "SELECT label::double AS label, " + S.r("list_sum(embedding::double[])") + " AS total, "
    + S.r("embedding[1]::double") + " AS first, " + S.r("embedding[64]::double") + " AS last FROM embeddings",
)
def _unstack_roundtrip(spark, folder):
    rows = unstack_blocks(stack_blocks(vectors(spark, folder), 64, block_size=48), 64)
    total = F.aggregate("features", F.lit(0.0), lambda acc, v: acc + v)
    return rows.select(
        "label",
        rounded(total).alias("total"),
        rounded(F.col("features")[0]).alias("first"),
        rounded(F.col("features")[63]).alias("last"),
    )


@query(
    "libsvm_lines",
    "SELECT concat_ws(' ', CASE WHEN p_size % 3 = 0 THEN '0' ELSE (p_size % 3)::varchar || '.0' END, "
    "CASE WHEN p_partkey % 5 <> 0 THEN '1:' || (p_partkey % 5)::varchar END, "
    "CASE WHEN p_size % 2 = 1 THEN '2:' || p_size::varchar END, "
    "CASE WHEN p_partkey <> 0 THEN '3:' || p_partkey::varchar END) AS value FROM part",
)
def _libsvm_lines(spark, folder):
    rows = table(spark, folder, "part").select(
        F.expr("cast(p_partkey % 5 as string)").alias("a"),
        F.expr("cast(p_size % 3 as string) || '.0'").alias("kind"),
        F.expr("if(p_size % 2 = 1, cast(p_size as string), '')").alias("b"),
        F.expr("cast(p_partkey as string)").alias("c"),
    )
    return csv_to_libsvm(rows, label_col=1)


@query(
    "libsvm_unlabelled",
    "SELECT concat_ws(' ', '1', '1:' || l_linenumber::varchar, "
    "CASE WHEN l_suppkey % 3 <> 0 THEN '2:' || (l_suppkey % 3)::varchar END, "
    "'3:' || l_quantity::bigint::varchar) AS value FROM lineitem",
)
def _libsvm_unlabelled(spark, folder):
    rows = table(spark, folder, "lineitem").selectExpr("l_linenumber", "l_suppkey % 3 AS s", "cast(l_quantity as bigint) AS q")
    return csv_to_libsvm(rows, no_labels=True)


_LIBSVM_SQL = S.with_(
    [S.EMBEDDING_ROWS, S.LABEL_ROWS],
    "SELECT label::double AS label, "
    + S.r("sum(v)") + " AS total, " + S.r("sum(v * (f + 1))") + " AS weighted "
    "FROM x JOIN y ON x.id = y.id GROUP BY x.id, label",
)


@query("libsvm_roundtrip", _LIBSVM_SQL)
def _libsvm_roundtrip(spark, folder):
    path = scratch_path(spark, "libsvm")
    write_lines(features_to_libsvm(vectors(spark, folder)), path)
    rows = labeled_rows(read_libsvm(spark, path, 64))
    added = F.aggregate("features", F.lit(0.0), lambda acc, v: acc + v)
    weighted = F.aggregate(
        F.transform("features", lambda v, i: v * (i + 1)), F.lit(0.0), lambda acc, v: acc + v
    )
    return rows.select("label", rounded(added).alias("total"), rounded(weighted).alias("weighted"))


# The embeddings as an image 25 pixels wide with 64 bands of whole numbers.
_CELL = "floor((v + 1) * 10000)"
_CELLS = "cells AS (SELECT (id // 25)::int AS row, (id % 25)::int AS col, f::int AS band, " + _CELL + "::int AS value FROM x)"


def _cells(spark, folder):
    """The image as cells numbered in channels-last storage order."""
    exploded = vectors(spark, folder).select("id", F.posexplode("features").alias("at", "v"))
    return exploded.select(
        (F.col("id") * 64 + F.col("at")).alias("position"),
        F.floor((F.col("v").cast("double") + 1) * 10000).cast("int").alias("value"),
    )


def _cube(spark, folder):
    # height matters for channels-first images only
    return cube_cells(_cells(spark, folder), 0, 25, 64).select("row", "col", "band", "value")


@query("cube_long", S.with_([S.EMBEDDING_ROWS, _CELLS], "SELECT row, col, band, value FROM cells"))
def _cube_long(spark, folder):
    return _cube(spark, folder)


@query(
    "cube_channels_first",
    "SELECT ((p % 500) // 25)::int AS row, ((p % 500) % 25)::int AS col, (p // 500)::int AS band, value FROM ("
    "SELECT (l_orderkey * 8 + l_linenumber)::bigint AS p, l_quantity::int AS value FROM lineitem)",
)
def _cube_channels_first(spark, folder):
    # line items as cells of a 20 x 25 image stored plane by plane
    cells = table(spark, folder, "lineitem").selectExpr("l_orderkey * 8 + l_linenumber AS position", "cast(l_quantity as int) AS value")
    return cube_cells(cells, 20, 25, 0, channels_last=False).select("row", "col", "band", "value")


_PIXELS = (
    "pixels AS (SELECT row, col, sum(value)::bigint AS total, sum(value * (band + 1))::bigint AS weighted, "
    "count(*) AS bands FROM cells GROUP BY row, col)"
)


def _sums(pixels):
    values = F.col("features").cast("array<bigint>")
    total = F.aggregate(values, F.lit(0).cast("bigint"), lambda acc, v: acc + v)
    weighted = F.aggregate(
        F.transform(values, lambda v, i: v * (i + 1)), F.lit(0).cast("bigint"), lambda acc, v: acc + v
    )
    return [total.alias("total"), weighted.alias("weighted"), F.size("features").cast("bigint").alias("bands")]


@query("cube_to_pixels", S.with_([S.EMBEDDING_ROWS, _CELLS, _PIXELS], "SELECT row, col, total, weighted, bands FROM pixels"))
def _cube_to_pixels(spark, folder):
    pixels = cube_to_pixels(_cube(spark, folder))
    return pixels.select("row", "col", *_sums(pixels))


@query("pixels_to_cube", S.with_([S.EMBEDDING_ROWS, _CELLS], "SELECT row, col, band, value FROM cells"))
def _pixels_to_cube(spark, folder):
    return pixels_to_cube(cube_to_pixels(_cube(spark, folder), unique=False))


def _truth(spark, folder):
    """Ground truth for all pixels but those of label 9."""
    rows = vectors(spark, folder).where("label <> 9")
    return rows.select(F.expr("cast(id div 25 as int)").alias("row"), F.expr("cast(id % 25 as int)").alias("col"), "label")


@query(
    "attach_labels",
    S.with_(
        [S.EMBEDDING_ROWS, S.LABEL_ROWS, _CELLS, _PIXELS],
        "SELECT p.row, p.col, t.label::int AS label, total FROM pixels p LEFT JOIN "
        "(SELECT id // 25 AS row, id % 25 AS col, label FROM y WHERE label <> 9) t ON p.row = t.row AND p.col = t.col",
    ),
)
def _attach_labels(spark, folder):
    pixels = attach_labels(cube_to_pixels(_cube(spark, folder)), _truth(spark, folder))
    return pixels.select("row", "col", "label", _sums(pixels)[0])


@query(
    "pixels_csv",
    S.with_(
        [S.EMBEDDING_ROWS, S.LABEL_ROWS, _CELLS],
        "SELECT (CASE WHEN label = 9 THEN '' ELSE label::varchar END) || ',' || "
        "string_agg(value::varchar, ',' ORDER BY band) AS line FROM cells "
        "JOIN y ON y.id = row * 25 + col GROUP BY row, col, label",
    ),
)
def _pixels_csv(spark, folder):
    """Lines of a cube with labels, in any order."""
    path = scratch_path(spark, "pixels")
    labelled = attach_labels(cube_to_pixels(_cube(spark, folder)), _truth(spark, folder))
    write_pixels_csv(labelled, path, label="label")
    rows = read_pixel_csv(spark, path, 65)
    return rows.select(F.concat_ws(",", *[F.coalesce(F.col(c), F.lit("")) for c in rows.columns]).alias("line"))


@query("pixels_csv_positions", S.with_([S.EMBEDDING_ROWS, _CELLS], "SELECT row, col, band, value FROM cells"))
def _pixels_csv_positions(spark, folder):
    """A cube written with its positions and read back to the same cells."""
    path = scratch_path(spark, "positions")
    write_pixels_csv(cube_to_pixels(_cube(spark, folder)), path, position=True)
    rows = read_pixel_csv(spark, path, 66)
    row, col, *bands = rows.columns
    cells = rows.select(F.col(row).cast("int").alias("row"), F.col(col).cast("int").alias("col"), F.posexplode(F.array(*bands)).alias("band", "said"))
    return cells.select("row", "col", "band", F.col("said").cast("double").cast("int").alias("value"))
