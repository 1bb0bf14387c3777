import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def shared_folder(tmp_path_factory):
    return str(tmp_path_factory.mktemp("shared"))


@pytest.fixture(scope="session")
def spark(shared_folder):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("weftsample-tests")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", shared_folder)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def orders(spark):
    return spark.read.parquet(f"{DATA}/orders.parquet").select("o_orderkey", "o_custkey")


@pytest.fixture(scope="session")
def events(spark):
    return spark.read.parquet(f"{DATA}/events.parquet").select("event_id", "user_id")


@pytest.fixture(scope="session")
def hand(spark):
    """a: 3 x 2 rows, b: 1 x 4, c left only, d right only, NULL: 1 x 2."""
    left = [("a", 1), ("a", 2), ("a", 3), ("b", 4), ("c", 5), ("c", 6), (None, 7)]
    right = [("a", 11), ("a", 12), ("b", 13), ("b", 14), ("b", 15), ("b", 16), ("d", 17),
             (None, 18), (None, 19)]
    return (
        spark.createDataFrame(left, "key string, lid long"),
        spark.createDataFrame(right, "key string, rid long"),
    )


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)
