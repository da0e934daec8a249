import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from millrace.base import ship

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.default.parallelism", "4").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return ship(s)


@pytest.fixture(scope="session")
def small():
    """The smallest driver tables."""
    return "/root/testdata/sf0.001"
