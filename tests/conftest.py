import os

import pytest
from pyspark.sql import SparkSession

os.environ.setdefault("PYTHONHASHSEED", "0")


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[4]").appName("tests").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
               .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    session.sparkContext.setLogLevel("OFF")
    yield session


@pytest.fixture
def engine(spark):
    from sedge.session import Engine

    return Engine(spark)
