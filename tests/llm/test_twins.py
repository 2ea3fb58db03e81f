"""Registered queries next to their SQL twins, on whole tables."""

from __future__ import annotations

import pytest

from remitloom.llm import queries
from tests.compare import compare, connect

from .conftest import SF


@pytest.mark.parametrize("name", list(queries.SQL))
def test_same_rows_as_sql(spark, name):
    ok, message = compare(queries.QUERIES[name](spark, SF), connect(SF), queries.SQL[name])
    assert ok, message
