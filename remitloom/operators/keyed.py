"""Change batches on keyed tables.

A form that saved one record becomes a batch of changes applied by one join.
The result is the whole new table; writing it to a new path is the caller's
step.  A batch must not name a key twice: the job fails if it does.

A large table is stored in partitions: by run, or by a number worked out from
its keys (``with_part``).  ``changes_*`` return a ``Changes``: the new rows of
the partitions a batch touches and the partitions that end empty.  The others
are neither read nor written (``store.apply``).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEW = "new_"
_HIT = "_hit"


def unique_batch(batch: DataFrame, keys: list[str]) -> DataFrame:
    """The batch with value columns prefixed ``new_`` and a match flag.

    Duplicates are found in the same aggregation that a join would need anyway,
    and only the offending job fails.
    """
    values = [c for c in batch.columns if c not in keys]
    grouped = batch.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(NEW + c) for c in values])
    flag = F.when(F.col("_n") > 1, F.raise_error(F.lit("change batch names a key twice: " + ", ".join(keys))))
    return grouped.withColumn(_HIT, flag.otherwise(F.lit(True)).cast("boolean")).drop("_n")


def _value(source: str | Column) -> Column:
    return F.col(NEW + source) if isinstance(source, str) else source


def keyed_update(target: DataFrame, batch: DataFrame, keys: list[str],
                 assignments: dict[str, str | Column]) -> DataFrame:
    """Set columns of the rows whose keys are in the batch.

    An assignment is a batch column, or an expression in which batch columns
    carry the prefix ``new_``.
    """
    joined = target.join(unique_batch(batch, keys), keys, "left")
    return joined.select(*[
        F.when(F.col(_HIT), _value(assignments[c])).otherwise(F.col(c)).alias(c)
        if c in assignments else F.col(c) for c in target.columns])


def keyed_upsert(target: DataFrame, batch: DataFrame, keys: list[str],
                 assignments: dict[str, str | Column],
                 on_insert: dict[str, str | Column] | None = None) -> DataFrame:
    """Update rows whose key is in the batch, add the batch rows whose key is new."""
    inserts = {**assignments, **(on_insert or {})}
    known = F.col("_known").isNotNull()
    joined = target.withColumn("_known", F.lit(True)).join(unique_batch(batch, keys), keys, "full")
    columns = []
    for c in target.columns:
        if c in keys:
            columns.append(F.col(c))
            continue
        changed = F.when(F.col(_HIT), _value(assignments[c])).otherwise(F.col(c)) if c in assignments else F.col(c)
        added = _value(inserts[c]) if c in inserts else F.lit(None)
        columns.append(F.when(known, changed).otherwise(added).alias(c))
    return joined.select(*columns)


def insert_if_absent(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Add the batch rows whose key the target does not have yet."""
    once = unique_batch(batch, keys).where(_HIT).select(*keys, *[F.col(NEW + c).alias(c) for c in batch.columns if c not in keys])
    missing = once.join(target.select(*keys), keys, "left_anti")
    return target.unionByName(missing, allowMissingColumns=True)


def delete_where(target: DataFrame, predicate: Column | None = None, batch: DataFrame | None = None,
                 keys: list[str] | None = None) -> DataFrame:
    """Drop the rows that satisfy a predicate, or whose keys are in a batch."""
    if predicate is not None:
        target = target.where(~F.coalesce(predicate, F.lit(False)))
    if batch is not None:
        target = target.join(batch.select(*keys), keys, "left_anti")
    return target


class Changes(NamedTuple):
    """New content of the touched partitions, and those of them that have no rows left."""

    rows: DataFrame
    emptied: DataFrame


def part_of(keys: list[str], parts: int) -> Column:
    """The partition of a key: a number below ``parts`` from a digest of the key columns, the same in any engine."""
    text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    return (F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("bigint") % parts).cast("int")


def with_part(table: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """A table with the column ``part`` it is stored by."""
    return table.withColumn("part", part_of(keys, parts))


def touch(target: DataFrame, batch: DataFrame, partition: str, change) -> Changes:
    """Apply ``change`` to the partitions of ``target`` that ``batch`` has rows of.

    The touched partitions, as many values as the table has folders at most,
    are a filter on the partition column that is known when the scan starts: a
    stored table is pruned whatever the batch looks like.
    """
    touched = batch.select(partition).distinct()
    named = touched.agg(F.collect_set(partition).alias("p")).scalar()
    rows = change(target.where(F.array_contains(named, F.col(partition))))
    return Changes(rows, touched.join(rows.select(partition), partition, "left_anti"))


def changes_of_upsert(target: DataFrame, batch: DataFrame, keys: list[str], assignments: dict[str, str | Column], parts: int,
                      on_insert: dict[str, str | Column] | None = None) -> Changes:
    """``keyed_upsert`` on a table stored by the ``part`` of its keys."""
    batch = with_part(batch, keys, parts)
    return touch(target, batch, "part", lambda rows: keyed_upsert(rows, batch, [*keys, "part"], assignments, on_insert))


def changes_of_update(target: DataFrame, batch: DataFrame, keys: list[str], assignments: dict[str, str | Column], parts: int) -> Changes:
    """``keyed_update`` on a table stored by the ``part`` of its keys."""
    batch = with_part(batch, keys, parts)
    return touch(target, batch, "part", lambda rows: keyed_update(rows, batch, [*keys, "part"], assignments))


def changes_of_delete(target: DataFrame, batch: DataFrame, keys: list[str], parts: int) -> Changes:
    """``delete_where`` by keys on a table stored by the ``part`` of its keys."""
    batch = with_part(batch.select(*keys), keys, parts)
    return touch(target, batch, "part", lambda rows: delete_where(rows, batch=batch, keys=[*keys, "part"]))


def key_existence(target: DataFrame, batch: DataFrame, keys: list[str],
                  predicate: Column | None = None) -> DataFrame:
    """The batch keys with ``found`` = 1 where the target has a matching row."""
    rows = target if predicate is None else target.where(predicate)
    wanted = batch.select(*keys).distinct()
    present = rows.select(*keys).join(wanted, keys, "left_semi").distinct().withColumn(_HIT, F.lit(1))
    return wanted.join(present, keys, "left").select(*keys, F.coalesce(F.col(_HIT), F.lit(0)).alias("found"))


def next_key(table: DataFrame, key: str) -> DataFrame:
    """One row: the highest key plus one."""
    return table.agg((F.max(F.col(key).cast("bigint")) + 1).alias("next_key"))


#: Ranges that rows are dealt into for numbering; bounds the table of their sizes.
RANGES = 4096


def _position(column: str, kind: str) -> Column:
    """A whole number that grows with the column; of a text its first six bytes count."""
    if kind == "date":
        return F.datediff(F.col(column), F.lit("0001-01-01").cast("date")).cast("bigint")
    if kind == "timestamp":
        return F.unix_micros(column)
    if kind == "string":
        return F.conv(F.rpad(F.hex(F.substring(F.encode(F.col(column), "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("bigint")
    return F.floor(F.col(column)).cast("bigint")


def number_rows(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Number rows 1, 2, 3 … in the order of some columns, nulls first, without one task seeing them all.

    Rows are dealt into up to ``RANGES`` stretches of the first column between
    its least and greatest value.  The stretches are a function of the row
    alone, so it does no harm that their sizes, which become the offsets, and
    the rows are read apart; nothing runs before the result is asked for.
    Inside a stretch rows are numbered by a window over it; stretches of equal
    width suit keys that are spread out.  Rows equal in all columns of ``order``
    are told apart by the others.
    """
    kind = rows.schema[order[0]].dataType.typeName()
    placed = rows.withColumn("_at", _position(order[0], kind))
    ends = placed.agg(F.struct(F.min("_at").alias("low"), F.max("_at").alias("high")).alias("e")).scalar()
    # as doubles, so that no difference of two whole numbers overflows; both readers round alike
    low, high = ends["low"].cast("double"), ends["high"].cast("double")
    stretch = F.least(F.floor((F.col("_at").cast("double") - low) * RANGES / F.greatest(high - low, F.lit(1.0))), F.lit(RANGES - 1))
    placed = placed.withColumn("_stretch", F.when(F.col("_at").isNull(), -1).otherwise(stretch).cast("int")).drop("_at")
    sizes = placed.groupBy("_stretch").agg(F.count(F.lit(1)).alias("n"))
    listed = sizes.agg(F.array_sort(F.collect_list(F.struct("_stretch", "n"))).alias("_all"))
    before = F.aggregate(F.slice("_all", F.lit(1), F.col("_pos")), F.lit(0).cast("bigint"), lambda total, s: total + s["n"])
    offsets = listed.select("_all", F.posexplode("_all").alias("_pos", "_one")).select(F.col("_one._stretch").alias("_s"), before.alias("_before"))
    inside = Window.partitionBy("_stretch").orderBy(*order, *[c for c in rows.columns if c not in order])
    numbered = placed.withColumn("_nth", F.row_number().over(inside))
    return numbered.join(offsets, F.col("_stretch") == F.col("_s")).withColumn(name, F.col("_before") + F.col("_nth")).select(*rows.columns, name)


def append_with_identity(target: DataFrame, batch: DataFrame, key: str, order: list,
                         stamps: dict[str, Column] | None = None) -> DataFrame:
    """Append a batch; its keys continue after the highest one in the target."""
    numbered = number_rows(batch, order, "_nth")
    start = target.agg(F.coalesce(F.max(F.col(key).cast("bigint")), F.lit(0)).alias("top"))
    added = numbered.withColumn(key, (start.scalar() + F.col("_nth")).cast(target.schema[key].dataType)).drop("_nth")
    for column, value in (stamps or {}).items():
        added = added.withColumn(column, value)
    return target.unionByName(added, allowMissingColumns=True)
