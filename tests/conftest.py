from __future__ import annotations

import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path[:0] = [str(Path(__file__).resolve().parent.parent), str(Path(__file__).resolve().parent)]

from bars import BAR_SCHEMA  # noqa: E402

from quantloom.session import prepare  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield prepare(session)


@pytest.fixture(scope="session")
def trend80(spark):
    """80 daily bars with a steady rise."""
    rows, price = [], 100.0
    for i in range(80):
        price += 0.4 + (i % 5) * 0.05
        rows.append(("INFY", datetime(2026, 1, 1) + timedelta(days=i), price - 0.4, price + 1, price - 1, price, 100000.0 + 1500 * i))
    return spark.createDataFrame(rows, BAR_SCHEMA)
