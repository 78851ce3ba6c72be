import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from hedgewise.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate one Column over literals: ``one(col, a=..., b=...)``."""
    from pyspark.sql import functions as F

    def run(column, schema=None, **values):
        if values:
            df = spark.createDataFrame([tuple(values.values())], schema or list(values))
        else:
            df = spark.range(1)
        return df.select(column.alias("x")).first()["x"]

    run.F = F
    return run
