"""Taking tables in: codes come to their normal form once, before anything compares them."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.text import KEY_COLUMNS, normalise_keys
from .store import save
from .tables import Tables


def tidy(df: DataFrame) -> DataFrame:
    """A table with its codes upper case and without trailing blanks; other columns, and codes kept as numbers, stay."""
    codes = [c for c, kind in df.dtypes if c in KEY_COLUMNS and kind == "string"]
    return normalise_keys(df, *codes) if codes else df


def tidied(tables: Tables) -> Tables:
    """The same tables, each tidied as it is read.

    For sources one does not own: a filter on a code is then tested after the
    scan.  Where a table is read often, ``land`` it instead.
    """
    return Tables(lambda name: tidy(tables[name]))


def land(df: DataFrame, path: str, partition_by: str | None = None, mode: str = "error") -> None:
    """Store a table in normal form, so that its readers compare and prune by the stored codes."""
    save(tidy(df), path, partition_by, mode)
