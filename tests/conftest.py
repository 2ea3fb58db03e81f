from __future__ import annotations

import pytest

from remitloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 8, partitions=4, memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """Small DataFrames from rows and a schema string."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)
