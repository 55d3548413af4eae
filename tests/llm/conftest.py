import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def spark():
    from tsengine.session import local_session

    return local_session(os.environ.get("TEST_CORES", "*"), app="tsengine-llm-tests", extra={"spark.sql.shuffle.partitions": "4"})


@pytest.fixture(scope="session")
def small(spark):
    """Rows of a small fixture as a DataFrame."""

    def make(rows, schema):
        return spark.createDataFrame(rows, schema)

    return make
