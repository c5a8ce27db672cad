import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", os.environ.get("TEST_CHECKPOINT_DIR") or str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture()
def make_rows(spark):
    """Builds a (label, features) table from arrays, over the given number of partitions."""

    def build(x, y=None, partitions=3):
        rows = [([float(v) for v in r], float(y[i]) if y is not None else 0.0, i) for i, r in enumerate(x)]
        df = spark.createDataFrame(rows, "features array<double>, label double, id long")
        return df.repartition(partitions, "id").select("features", "label") if partitions else df

    return build
