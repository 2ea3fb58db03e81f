"""Named input tables.

Operators take DataFrames; pipelines that need a dozen of them take a
``Tables`` object, which resolves a name only when it is asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """Lazy, read-only collection of input tables."""

    def __init__(self, resolve: Callable[[str], DataFrame]):
        self._resolve = resolve
        self._known: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._known:
            self._known[name] = self._resolve(name)
        return self._known[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self[name]

    @classmethod
    def of(cls, frames: Mapping[str, DataFrame]) -> "Tables":
        """From DataFrames at hand."""
        return cls(lambda name: frames[name])

    @classmethod
    def parquet(cls, spark: SparkSession, folder: str) -> "Tables":
        """One parquet table per name in a folder."""
        return cls(lambda name: spark.read.parquet(f"{folder}/{name}.parquet"))

    @classmethod
    def catalog(cls, spark: SparkSession, database: str = "default") -> "Tables":
        """Tables of the session catalog, for instance bucketed ones."""
        return cls(lambda name: spark.table(f"{database}.{name}"))
