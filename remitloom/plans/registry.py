"""The catalogue of registered queries."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from ..sources.bindings import bind
from ..sources.tables import Tables
from .fixtures_sql import with_tables


class Query(NamedTuple):
    build: Callable[[Tables], DataFrame]
    sql: str | None


CATALOGUE: dict[str, Query] = {}


def register(name: str, build: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
    """Add a query: a builder over the derived tables, and the same thing in SQL."""
    if name in CATALOGUE:
        raise ValueError(f"{name} is registered twice")
    CATALOGUE[name] = Query(build, sql)


def runnable(query: Query) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query.build(bind(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()
    return {name: runnable(q) for name, q in CATALOGUE.items()}


def oracle_sql() -> dict[str, str]:
    load()
    return {name: with_tables(q.sql) for name, q in CATALOGUE.items() if q.sql is not None}


def load() -> None:
    """Import the modules that fill the catalogue."""
    from . import aging, budget, changes, cheques, commission, masters, rating, review, text_rule  # noqa: F401
