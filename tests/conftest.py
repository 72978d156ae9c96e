import os
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import cuelab  # noqa: E402
import queries  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    cloudpickle.register_pickle_by_value(cuelab)
    cloudpickle.register_pickle_by_value(queries)
    cloudpickle.register_pickle_by_value(sys.modules["tests"]) if "tests" in sys.modules else None
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def values(df, *cols):
    """Rows as sorted tuples."""
    rows = df.select(*cols).collect() if cols else df.collect()
    return sorted((tuple(r) for r in rows), key=repr)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()
