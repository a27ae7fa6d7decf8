from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def apply(spark):
    """Evaluate a column function over a list of strings, in order."""
    from pyspark.sql import functions as F

    def run(values, function):
        rows = spark.createDataFrame(list(enumerate(values)), "i int, x string")
        return [r["y"] for r in rows.select("i", function(F.col("x")).alias("y")).orderBy("i").collect()]

    return run
