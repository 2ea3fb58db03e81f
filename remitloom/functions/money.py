"""Decimal arithmetic: amounts stay decimal from the scan to the result."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

AMOUNT = "decimal(18,2)"
PERCENT = "decimal(9,2)"
ZERO = Decimal("0.00")


def amount(col: Column | str) -> Column:
    """Cast to an amount with two decimals, rounding half away from zero."""
    return (F.col(col) if isinstance(col, str) else col).cast(AMOUNT)


def total(col: Column | str) -> Column:
    """Sum of amounts, kept as an amount."""
    return F.sum(amount(col)).cast(AMOUNT)


def or_zero(col: Column | str) -> Column:
    """NULL counts as 0.00."""
    return F.coalesce(amount(col), F.lit(ZERO).cast(AMOUNT))


def percent_of(base: Column, percent: Column) -> Column:
    """``base * percent / 100`` rounded once, to two decimals.

    18+9 digits and the factor 0.01 stay below 38, so Spark never drops a
    decimal before the final rounding.
    """
    product = base.cast(AMOUNT) * percent.cast(PERCENT)
    return (product * F.lit(Decimal("0.01"))).cast(AMOUNT)


def ratio_percent(part: Column, whole: Column) -> Column:
    """``part / whole * 100`` as an amount; NULL where ``whole`` is zero."""
    return F.try_divide(part.cast(AMOUNT) * F.lit(100), whole.cast(AMOUNT)).cast(AMOUNT)


def at_scale(col: Column, scale: int) -> Column:
    """Round to ``scale`` decimals, the way the rating tables store numbers."""
    return col.cast(f"decimal(18,{scale})")


def shared_amount(line: Column, rate: Column, fixed: Column, share: Column) -> Column:
    """``(line * rate/100 + fixed) * share/100`` rounded once, to two decimals.

    Both divisions are postponed: the product has at most six decimals and is
    exact, is then rounded to hundreds and scaled by 1/10,000, so no
    intermediate rounding can creep in.  The arguments have at most 18 digits.
    """
    line, rate, fixed, share = (F.coalesce(c, F.lit(0).cast("decimal(1,0)")) for c in (line, rate, fixed, share))
    product = (line * rate + fixed * F.lit(Decimal("100"))) * share
    return (F.round(product, -2) * F.lit(Decimal("0.0001"))).cast(AMOUNT)
