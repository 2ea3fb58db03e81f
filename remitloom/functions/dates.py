"""Calendar expressions.  "Today" is always a parameter, never the clock."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN_END = dt.date(2099, 12, 31)
UNCLEARED = dt.date(1900, 1, 2)


def day(value: dt.date | str | Column) -> Column:
    """A date literal; a column stays as it is."""
    return value if isinstance(value, Column) else F.lit(str(value)).cast("date")


def month_start(col: Column) -> Column:
    return F.trunc(col, "MM").cast("date")


def month_label(col: Column) -> Column:
    """'January 2020'."""
    return F.date_format(col, "MMMM yyyy")


def years_apart(earlier: Column, later: Column) -> Column:
    """Number of new-year boundaries between two dates."""
    return F.year(later) - F.year(earlier)


def day_span(first: str, last: str, alias: str) -> Column:
    """One row per day of a closed interval, to turn it into an equi-join key."""
    return F.explode(F.sequence(F.col(first), F.col(last))).alias(alias)
