"""Every registered query on the smallest data set: its plan, and its result next to the SQL twin."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry
from remitloom.plans import registry
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, TWINS = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def check_plan(plan: str) -> None:
    """No pairing of everything with everything, no Python per row, no window over a whole table."""
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert bad not in plan, bad
    for window in re.findall(r"Window \[.*?\], \[.*?\]|Window \[.*?\]", plan):
        # the only window without a partition runs over one row per sort partition
        assert "_size" in window or ", [" in window, window


@pytest.mark.parametrize("name", list(QUERIES))
def test_plan_and_result(spark, duck, name):
    df = QUERIES[name](spark, SF)
    check_plan(df._jdf.queryExecution().executedPlan().toString())
    ok, message = compare(df, duck, TWINS[name])
    assert ok, message


def test_every_query_has_a_twin_and_is_registered():
    assert set(QUERIES) == set(TWINS)
    assert set(QUERIES) <= set(entry.queries()) and set(TWINS) <= set(entry.oracle_sql())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
