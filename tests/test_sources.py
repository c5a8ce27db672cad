import numpy as np
import pytest
from pyspark.sql import functions as F

from bandnet.operators import labeled_rows
from bandnet.sources import (
    attach_labels,
    csv_to_libsvm,
    cube_cells,
    cube_to_pixels,
    features_to_libsvm,
    pixel_lines,
    pixels_to_cube,
    read_libsvm,
    read_pixel_csv,
    scratch_path,
    write_lines,
    write_pixels_csv,
)


def test_csv_lines(spark, tmp_path):
    (tmp_path / "in.csv").write_text("0.0,1.50,0,,3\n2,0.0,-1,7e1,0.00\n5,0,0,0,0\n")
    rows = read_pixel_csv(spark, str(tmp_path / "in.csv"), 5)
    assert [r.value for r in csv_to_libsvm(rows).collect()] == ["0 1:1.50 4:3", "2 2:-1 3:7e1", "5"]
    assert [r.value for r in csv_to_libsvm(rows, label_col=2).collect()] == [
        "0 2:1.50 4:3",
        "-1 1:2 3:7e1",
        "0 1:5",
    ]
    assert csv_to_libsvm(rows, label_col="_c4").first().value == "3 2:1.50"
    assert [r.value for r in csv_to_libsvm(rows, no_labels=True).collect()] == [
        "1 2:1.50 5:3",
        "1 1:2 3:-1 4:7e1",
        "1 1:5",
    ]


def test_csv_width_may_be_left_to_spark(spark, tmp_path):
    (tmp_path / "in.csv").write_text("1,2,3\n")
    assert read_pixel_csv(spark, str(tmp_path / "in.csv")).columns == ["_c0", "_c1", "_c2"]


def test_bad_labels_and_items_are_errors(spark):
    missing = spark.createDataFrame([(None, "1")], "a string, b string")
    with pytest.raises(Exception, match="no label"):
        csv_to_libsvm(missing).collect()
    for row in (("1", "x"), ("x", "1")):
        words = spark.createDataFrame([row], "a string, b string")
        for ansi in ("true", "false"):
            spark.conf.set("spark.sql.ansi.enabled", ansi)
            try:
                with pytest.raises(Exception, match="not a number: x"):
                    csv_to_libsvm(words).collect()
            finally:
                spark.conf.unset("spark.sql.ansi.enabled")


def test_libsvm_roundtrip(spark, make_rows):
    x = np.array([[0.0, 1.5, -2.0], [0.0, 0.0, 0.0], [1e-17, 3.0, 0.1]])
    path = scratch_path(spark, "roundtrip")
    write_lines(features_to_libsvm(make_rows(x, [0, 1, 2])), path)
    for width in (3, None):
        back = {r.label: list(r.features) for r in labeled_rows(read_libsvm(spark, path, width)).collect()}
        assert back == {float(i): list(r) for i, r in enumerate(x)}


@pytest.mark.parametrize("channels_last", [True, False])
def test_cube_layouts(spark, channels_last):
    height, width, bands = 3, 4, 5
    cube = np.arange(height * width * bands, dtype=np.int64).reshape(
        (height, width, bands) if channels_last else (bands, height, width)
    )
    cells = spark.createDataFrame([(i, int(v)) for i, v in enumerate(cube.reshape(-1))], "position long, value int")
    pixels = cube_to_pixels(cube_cells(cells.repartition(3), height, width, bands, channels_last))
    image = cube if channels_last else cube.transpose(1, 2, 0)
    got = {(r.row, r.col): r.features for r in pixels.collect()}
    assert got == {(i, j): list(image[i, j]) for i in range(height) for j in range(width)}
    long = pixels_to_cube(pixels)
    assert {(r.row, r.col, r.band): r.value for r in long.collect()} == {
        (i, j, k): int(image[i, j, k]) for i in range(height) for j in range(width) for k in range(bands)
    }


def test_repeated_cells(spark):
    cells = spark.createDataFrame([(0, 0, 0, 1), (0, 0, 0, 1), (0, 0, 1, 2)], "row int, col int, band int, value int")
    assert cube_to_pixels(cells).first().features == [1, 2]
    clash = cells.unionByName(spark.createDataFrame([(0, 0, 1, 9)], cells.schema))
    assert cube_to_pixels(clash, unique=False).first().features == [1, 9]
    with pytest.raises(Exception, match="two values for one band"):
        cube_to_pixels(clash).collect()


def test_repeated_labels(spark):
    pixels = spark.createDataFrame([(0, 0, [1]), (0, 1, [2])], "row int, col int, features array<int>")
    truth = spark.createDataFrame([(0, 0, 5)] * 50 + [(0, 1, None)], "row int, col int, label int")
    rows = attach_labels(pixels, truth).orderBy("col").collect()
    assert [(r.col, r.label) for r in rows] == [(0, 5), (1, None)]
    clash = truth.unionByName(spark.createDataFrame([(0, 0, 6)], truth.schema))
    with pytest.raises(Exception, match="two labels"):
        attach_labels(pixels, clash).collect()


def test_labels_and_csv_sink(spark):
    pixels = spark.createDataFrame([(0, 0, [1, 2]), (0, 1, [3, 4])], "row int, col int, features array<int>")
    truth = spark.createDataFrame([(0, 1, 7)], "row int, col int, label int")
    labelled = attach_labels(pixels, truth)
    assert labelled.columns == ["row", "col", "label", "features"]
    assert sorted(r.value for r in pixel_lines(labelled, label="label").collect()) == [",1,2", "7,3,4"]
    path = scratch_path(spark, "csv")
    write_pixels_csv(pixels, path)
    assert sorted(tuple(r) for r in read_pixel_csv(spark, path, 2).collect()) == [("1", "2"), ("3", "4")]


def test_scratch_lies_in_the_shared_folder(spark):
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
