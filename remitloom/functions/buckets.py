"""Age classes of unpaid amounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .money import AMOUNT, amount

# Labels of the age classes and the last day of each.
AGE_CLASSES = [
    ("D01_30", 30),
    ("D31_60", 60),
    ("D61_90", 90),
    ("D91_120", 120),
    ("Over120", None),
]
AGE_LABELS = [label for label, _ in AGE_CLASSES]


def age_class(days: Column) -> Column:
    """Label of the age class; NULL for amounts that are not due yet."""
    label = F.when(days < 0, F.lit(None).cast("string"))
    for name, last in AGE_CLASSES:
        label = label.otherwise(F.lit(name)) if last is None else label.when(days <= last, name)
    return F.when(days.isNotNull(), label)


def aging_bucket_pivot(rows: DataFrame, days: str, value: str, keys: list[str]) -> DataFrame:
    """Sum ``value`` per ``keys`` into one column per age class.

    Amounts not due yet drop out.  Conditional sums give the pivot in a single
    partial aggregation, without a second grouping on the class.
    """
    label = age_class(F.col(days))
    due = rows.where(label.isNotNull())
    columns = [
        F.sum(F.when(label == name, amount(value))).cast(AMOUNT).alias(name) for name in AGE_LABELS
    ]
    return due.groupBy(*keys).agg(*columns)
