"""Codes compare without case and trailing blanks."""

from __future__ import annotations

import re

import pytest

from remitloom.functions.text import KEY_COLUMNS, only_branches, optional
from remitloom.plans import registry, text_rule
from remitloom.sources import bindings, ingest
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.fixture
def tables(spark):
    return bindings.bind(spark, SF)


def test_derived_codes_are_in_normal_form(tables):
    for name in bindings._recipes:
        df = tables[name]
        codes = [c for c, kind in df.dtypes if c in KEY_COLUMNS and kind == "string"]
        if codes:
            wrong = " or ".join(f"`{c}` <> upper(rtrim(`{c}`))" for c in codes)
            assert df.where(wrong).isEmpty(), name


def test_tidy_undoes_every_spelling(tables):
    df = tables.rb_payees
    untidy = text_rule.spelled_anew(df)
    assert untidy.exceptAll(df).count() > df.count() / 2
    assert ingest.tidy(untidy).exceptAll(df).isEmpty()


@pytest.mark.parametrize("name", text_rule.UNDER_THE_RULE)
def test_without_the_rule_rows_are_lost(tables, duck, name):
    registry.load()
    query = registry.CATALOGUE[name]
    ok, _ = compare(query.build(text_rule.untidy(tables)), duck, registry.with_tables(query.sql))
    assert not ok


def test_joins_stay_hash_joins_and_groupings_hash_aggregates(spark, tables):
    t = ingest.tidied(text_rule.untidy(tables))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = registry.CATALOGUE["payee_sharing_split"].build(t)._jdf.queryExecution().executedPlan().toString()
        assert "HashJoin" in plan and not re.search(r"NestedLoop|Cartesian", plan)
        plan = t.inv1.groupBy("whscode", "itemcode").count()._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan and "SortAggregate" not in plan
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_filters_take_any_spelling(frame):
    rows = frame([("AB", "Müller "), ("CD", "MÜLLER"), (None, None)], "cardcode string, cardname string")
    assert optional(rows, cardcode="ab  ").count() == 1 and optional(rows, cardname="müller").count() == 2
    assert optional(rows, cardcode="ALL ", cardname=None).count() == 3 and optional(rows, cardcode="a b").count() == 0
    assert only_branches(rows, ["cd ", "x"], "cardcode").count() == 1
    assert only_branches(rows, "All ", "cardcode").count() == 3 and only_branches(rows, "", "cardcode").count() == 3


def test_a_filter_on_a_landed_code_reaches_the_scan(spark, frame, tmp_path):
    ingest.land(frame([("ab ", 1), ("Cd", 2)], "whscode string, n int"), f"{tmp_path}/t")
    found = only_branches(spark.read.parquet(f"{tmp_path}/t"), "cd  ")
    assert [tuple(r) for r in found.collect()] == [("CD", 2)]
    assert re.search(r"PushedFilters: \[.*whscode,CD|PushedFilters: \[.*In\(whscode", found._jdf.queryExecution().executedPlan().toString())
