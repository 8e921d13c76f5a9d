import os
import sys

import numpy as np
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def blobs(spark):
    """Three separated Gaussian clouds: matrix, labels and table."""
    draw = np.random.default_rng(7)
    centers = draw.normal(size=(3, 8)) * 6
    labels = np.repeat([0, 1, 2], 60)
    x = centers[labels] + draw.normal(size=(180, 8))
    return x, labels, frame(spark, x, labels)


def frame(spark, x, labels=None, parts=4):
    labels = np.zeros(len(x), dtype=int) if labels is None else labels
    rows = [(int(i), int(c), [float(v) for v in r]) for i, (r, c) in enumerate(zip(x, labels))]
    return spark.createDataFrame(rows, "row_id long, label int, embedding array<double>").repartition(parts)


def matrix(df, column="embedding"):
    return np.array([r[column] for r in df.orderBy("row_id").collect()])
