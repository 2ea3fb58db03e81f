"""Joins whose key may hold a large part of the rows, and joins whose other side must not be sent whole.

Keys with many rows are counted and listed with the number of slices their rows
are to be dealt into.  The rows of such a key are numbered by a hash of their
own columns, the other side stands once per slice, and the join is by key and
slice.  A key that is not listed has one slice, so a list that misses a key, or
is old, costs time and never changes a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one key that one task may well take.
SLICE_ROWS = 2_000_000


def never_sent(table: DataFrame) -> DataFrame:
    """A side of a join that is shuffled, whatever size the planner expects.

    Spark judges a table by its files: codes and names that compress well are 30 times as large in memory, an explode
    is not counted at all, and the whole would be gathered on the driver to be sent to every task.  So whatever grows
    with accounts, payees, items or documents is marked.  Such a join also moves as much a row on a small table as on
    a large one, instead of changing its plan in between.
    """
    return table.hint("merge")


def key_hash(columns: list[Column | str]) -> Column:
    """One number for a key of any types; two keys that share it only share their number of slices."""
    return F.xxhash64(*[(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns])


def heavy_keys(rows: DataFrame, columns: list[Column | str], slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(key, slices): the keys of two slices of rows or more, at most one for every ``2 * slice_rows`` rows.

    Only the key columns are read, and counts are added up before they move.
    Counts are exact rather than sketched: both sides of a join must see the
    same number of slices although each may work it out for itself, and merged
    sketches depend on the order they arrive in.
    """
    return rows.select(key_hash(columns).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(
        F.col("n") >= 2 * slice_rows).select("key", F.ceil(F.col("n") / F.lit(slice_rows)).cast("int").alias("slices"))


def spread_join(rows: DataFrame, other: DataFrame, keys: dict[str, Column], by: list[str], heavy: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``other``, heavy keys in slices.

    ``keys`` gives, for each key column of ``other``, the expression of it over
    ``rows``; ``heavy`` was found with the same expressions in the same order.
    ``by`` names columns that tell the rows of a key apart: a lost task deals
    its rows as before.  The key columns of ``other`` are dropped.  ``heavy`` is
    broadcast: at ``SLICE_ROWS`` a table of 10^12 rows has at most 250,000
    heavy keys of 12 bytes.  Key and slice are one value, so that no layout by
    the key alone is reused; a row with a null in its key meets nothing.
    """
    heavy = F.broadcast(heavy)
    found, hashed = F.coalesce("_slices", F.lit(1)), heavy.select(F.col("key").alias("_heavy"), F.col("slices").alias("_slices"))

    def counted(side, values):
        return side.withColumn("_hash", key_hash(values)).join(hashed, F.col("_hash") == F.col("_heavy"), "left")

    def named(values, slice_, name):
        known = F.lit(True)
        for value in values:
            known = known & value.isNotNull()
        return F.when(known, F.struct(*[v.alias(f"k{i}") for i, v in enumerate(values)], slice_.alias("slice"))).alias(name)

    of_rows, of_other = list(keys.values()), [F.col(k) for k in keys]
    place = F.pmod(F.xxhash64(*by), found).cast("int")
    left = counted(rows, of_rows).select(*rows.columns, named(of_rows, place, "_l"))
    copies = counted(other, of_other).withColumn("_copy", F.explode(F.sequence(F.lit(0), found - 1)))
    right = copies.select(named(of_other, F.col("_copy"), "_r"), *[c for c in other.columns if c not in keys])
    return left.join(right, F.col("_l") == F.col("_r"), how).drop("_l", "_r")
