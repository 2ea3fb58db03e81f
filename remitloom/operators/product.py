"""Every row of one table with every row of a smaller one, where the product is the result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of the smaller table that travel together, and tasks a block's rows are spread over.
BLOCK, SPREAD = 1000, 64


def product(rows: DataFrame, other: DataFrame, block: int = BLOCK, spread: int = SPREAD) -> DataFrame:
    """``rows`` × the distinct rows of ``other``, as a join of blocks.

    The smaller table is dealt into blocks of about ``block`` rows by a hash,
    as many as its size asks for; a block is one array.  Each row names every
    block and one of ``spread`` copies of it, so the join is by (block, copy):
    Spark sends the blocks to all tasks while they are small by its own
    measure, and else shuffles, where no key has more than its share of rows.
    The pair is one key, so that no layout by the block alone will do.
    """
    columns = other.columns
    other = other.distinct()
    blocks = other.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / F.lit(block))).cast("int").alias("n")).scalar()
    dealt = other.withColumn("_block", F.pmod(F.xxhash64(*columns), blocks).cast("int")).groupBy("_block").agg(
        F.collect_list(F.struct(*columns)).alias("_rows")).withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    left = rows.withColumn("_copy", F.pmod(F.xxhash64(*rows.columns), F.lit(spread)).cast("int")).withColumn(
        "_block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    left, dealt = (side.withColumn(key, F.struct("_block", "_copy")) for side, key in ((left, "_l"), (dealt, "_r")))
    return left.join(dealt.select("_r", "_rows"), F.col("_l") == F.col("_r")).withColumn("_row", F.explode("_rows")).select(*rows.columns, *[F.col(f"_row.{c}").alias(c) for c in columns])
