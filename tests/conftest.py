import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from decklens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def apply(spark):
    """Apply a Column -> Column function to plain values and return the results as a list."""
    from pyspark.sql import functions as F

    def run(fn, values, type_="string"):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_}")
        return [r.x for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]

    return run
