import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerloom.settings import configure  # noqa: E402
from tests.books import Books  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = configure(
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.showConsoleProgress", "false")
    ).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def books():
    return Books()
