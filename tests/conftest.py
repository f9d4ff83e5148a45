import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, _ROOT)

from repograph.ship import ship_packages  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("repograph-tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-", dir="/tmp"))
        .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    ship_packages(session, os.path.join(_ROOT, "repograph"), os.path.join(_ROOT, "catalog"))
    yield session
    session.stop()
