"""Connected components of a graph of documents, by contraction on Spark.

Each round gives every node a new random rank, a hash of its id and the round.
A node goes to the lowest in rank among itself and its neighbours, follows that
mapping once more, and the ends of all edges are replaced; edges inside a
contracted node go.  Ranks make every graph look alike: in a chain, whatever
its ids, about two of three nodes go in a round even without the second step,
so the number of rounds grows with the logarithm of the nodes.  At last each
component is named by its least node.  Nothing but whether edges are left
reaches the driver.  A node with very many edges is an ordinary key of partial
sums and of joins that split skew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import freeze


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge; component: the least node reachable.

    ``edges``: columns a and b, in any direction, repeated or equal ends allowed; nulls are left out.
    """
    edges = freeze(edges.where("a is not null and b is not null").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    where = freeze(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")), "nodes")
    left, turn = edges.where("a < b"), 0
    while not left.isEmpty():
        both = left.select("a", "b").union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ranked = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("rank"), F.col(c).alias("id"))  # noqa: E731, B023
        step = freeze(both.groupBy(F.col("a").alias("node")).agg(F.least(ranked("node"), F.min(ranked("b")))["id"].alias("to")), "step")
        further = step.select(F.col("node").alias("_n"), F.col("to").alias("_t"))
        step = freeze(step.join(further, F.col("to") == F.col("_n")).select("node", F.col("_t").alias("to")), "step")
        moved = step.select(F.col("node").alias("_n"), F.col("to").alias("_t"))
        where = freeze(where.join(moved, F.col("component") == F.col("_n"), "left").select(
            "node", F.coalesce("_t", "component").alias("component")), "nodes")
        ends = left.join(moved, F.col("a") == F.col("_n")).select(F.col("_t").alias("a"), "b")
        ends = ends.join(moved, F.col("b") == F.col("_n")).select(F.col("a"), F.col("_t").alias("b"))
        left = freeze(ends.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        turn += 1
    least = where.groupBy(F.col("component").alias("_c")).agg(F.min("node").alias("_least"))
    return freeze(where.join(least, F.col("component") == F.col("_c")).select("node", F.col("_least").alias("component")), "components")
