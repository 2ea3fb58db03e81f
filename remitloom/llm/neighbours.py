"""Nearest neighbours by inner product, with cross-polytope hashing.

A vector gets one more coordinate that brings all to the same length (a query
gets 0 there), so the largest inner product is the smallest angle.  A table's
hash rotates it pseudo-randomly, three times random signs and a fast Hadamard
transform, and takes the nearest of the signed axes.  Further hash values on
fewer axes are joined to it as the table grows, so that a bucket holds about
``bucket_rows`` rows.  A query visits in each table the buckets of its nearest
signed axes (multiprobe); what it meets there is ranked by matrix products,
and the best of all buckets are scored again on the original vectors.

Buckets are worked on in blocks of rows and of queries, so a bucket with a
third of all rows is many small tasks.  Equal vectors are indexed once for each
of the k + 1 least ids, as no more of them can be among k results.  A query
that met too few rows is compared with all of them, in blocks.

Defined cases: a vector that is null, zero, of another length than most, or
holds null or non-finite components takes no part, as query or as candidate;
of rows that share an id the one with the least vector counts; ties go to the
smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import freeze, map_arrow

BLOCK_ROWS, BLOCK_QUERIES = 4096, 1024


def usable(vectors: DataFrame, id_: str, vector: str) -> DataFrame:
    """(vec_id, v, norm2) of the rows that take part; v in double precision."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(id_).cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    rows = rows.where(F.size("v") == (common["n"] if common else 0)).groupBy("vec_id").agg(F.min("v").alias("v"))
    return rows.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))


def dot(a: str, b: str) -> Column:
    """Inner product, added up from the first component on."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    """Three rounds of random signs and Hadamard transform; x has a power of two of columns."""
    rng = np.random.default_rng(seed)
    n = x.shape[1]
    for _ in range(3):
        x = x * rng.choice([-1.0, 1.0], n)
        step = 1
        while step < n:
            pairs = x.reshape(len(x), -1, 2, step)
            x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), n)
            step *= 2
        x = x / np.sqrt(n)
    return x


def signed_axes(x: np.ndarray) -> np.ndarray:
    """How far a vector reaches along each axis and against it."""
    return np.concatenate([x, -x], axis=1)


def codes(x: np.ndarray, table: int, parts: list[int], probes: int) -> np.ndarray:
    """The ``probes`` nearest buckets of each vector, nearest first; ``parts``: axes of each hash value."""
    best_codes, best_loss = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
    for k, axes in enumerate(parts):
        reach = signed_axes(rotate(x, 1000 * k + table)[:, :axes])
        loss = (reach.max(axis=1, keepdims=True) - reach) ** 2
        few = np.argsort(loss, axis=1, kind="stable")[:, :probes]
        loss = (best_loss[:, :, None] + np.take_along_axis(loss, few, 1)[:, None, :]).reshape(len(x), -1)
        all_ = (best_codes[:, :, None] * (2 * axes) + few[:, None, :]).reshape(len(x), -1)
        keep = np.argsort(loss, axis=1, kind="stable")[:, :probes]
        best_codes, best_loss = np.take_along_axis(all_, keep, 1), np.take_along_axis(loss, keep, 1)
    return best_codes


def hash_shape(dimension: int, rows: int, bucket_rows: int, probes: int) -> tuple[list[int], int]:
    """(axes of each hash value, probes): more values, and in step with the root of their number more probes, for more rows."""
    width = 1 << dimension.bit_length()  # for one coordinate more
    parts, buckets = [width], 2 * width
    while rows / buckets > 2 * bucket_rows:
        axes = min(width, 1 << max(int(rows / buckets / bucket_rows / 2).bit_length() - 1, 0))
        parts.append(axes)
        buckets *= 2 * axes
    return parts, round(probes * (buckets / (2 * width)) ** 0.5)


def hashed(rows: DataFrame, tables: int, parts: list[int], probes: int, longest: float, as_query: bool) -> DataFrame:
    """(vec_id, v, t, code): a row for each bucket that a vector lies in, or visits."""
    width = parts[0]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            x = np.zeros((len(v), width))
            x[:, :v.shape[1]] = v / longest
            if as_query:
                x /= np.sqrt((x**2).sum(axis=1, keepdims=True))
            else:
                x[:, v.shape[1]] = np.sqrt(np.maximum(1 - (x**2).sum(axis=1), 0))
            all_ = np.concatenate([codes(x, t, parts, probes) for t in range(tables)], axis=1)
            each = all_.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * each), pa.array(all_.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["vec_id", "v", "codes"])

    made = map_arrow(rows.select("vec_id", "v"), run, "vec_id long, v array<double>, codes array<long>")
    return made.select("vec_id", "v", F.posexplode("codes").alias("_at", "code")).select(
        "vec_id", "v", F.expr(f"_at div {probes}").cast("int").alias("t"), "code")


def best_in_blocks(queries: DataFrame, rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(query_id, vec_id, near): the k nearest rows of every query within each block of ``keys``."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "near": pa.array([], pa.float64())}
        if left.num_rows and right.num_rows:
            q, r = (t.column("v").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1) for t in (left, right))
            q_id, r_id = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
            order = np.argsort(r_id, kind="stable")
            near = q @ r[order].T
            near[q_id[:, None] == r_id[order][None, :]] = -np.inf
            few = np.argsort(-near, axis=1, kind="stable")[:, :k]
            values = np.take_along_axis(near, few, 1)
            ok = values > -np.inf
            out = {"query_id": pa.array(np.repeat(q_id, few.shape[1])[ok.reshape(-1)]), "vec_id": pa.array(r_id[order][few][ok]), "near": pa.array(values[ok])}
        return pa.table(out)

    pairs = queries.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, near double")
    return pairs


def blocks(n: Column, most: int) -> Column:
    return F.ceil(n / most).cast("int")


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_: str = "vec_id", vector: str = "embedding", tables: int = 16, probes: int = 12,
           bucket_rows: int = 512) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the largest inner product found for each query among all other rows.

    ``is_query``: condition on ``vec_id``.  More ``tables`` or ``probes`` find more and read more.
    """
    rows = freeze(usable(vectors, id_, vector), "vectors")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max("norm2").alias("most"), F.max(F.size("v")).alias("d")).first()
    empty = rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.col("norm2").alias("score")).where("false")
    if not size["n"]:
        return empty
    longest = float(np.sqrt(size["most"])) * (1 + 1e-12)
    parts, probes = hash_shape(size["d"], size["n"], bucket_rows, probes)
    copies = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    indexed = rows.withColumn("_copy", copies).where(F.col("_copy") <= k + 1)
    queries = rows.where(is_query)

    placed = hashed(indexed, tables, parts, 1, longest, as_query=False)  # hashed again for each use, which costs less than to store it
    visits = hashed(queries, tables, parts, probes, longest, as_query=True)
    counts = placed.groupBy("t", "code").agg(F.count(F.lit(1)).alias("_n")).join(
        visits.groupBy("t", "code").agg(F.count(F.lit(1)).alias("_q")), ["t", "code"])
    sizes = freeze(counts.select("t", "code", blocks(F.col("_n"), BLOCK_ROWS).alias("_nb"), blocks(F.col("_q"), BLOCK_QUERIES).alias("_qb")), "sizes")
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = visits.join(sizes, ["t", "code"]).withColumn("qb", own("_qb")).withColumn("nb", every("_nb")).drop("_nb", "_qb")
    right = placed.join(sizes, ["t", "code"]).withColumn("nb", own("_nb")).withColumn("qb", every("_qb")).drop("_nb", "_qb")
    met = best_in_blocks(left, right, ["t", "code", "qb", "nb"], k).groupBy("query_id", "vec_id").agg(F.max("near").alias("near"))
    met = freeze(met, "met")

    enough = met.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min(k, size["n"] - 1)).select(F.col("query_id").alias("vec_id"))
    short = freeze(queries.join(enough, "vec_id", "left_anti").select("vec_id", "v"), "short")
    n_short = short.count()
    if n_short:
        nb, qb = -(-size["n"] // BLOCK_ROWS), -(-n_short // BLOCK_QUERIES)
        hash_ = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
        left = short.withColumn("qb", hash_(qb)).withColumn("nb", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))))
        right = indexed.select("vec_id", "v").withColumn("nb", hash_(nb)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(qb - 1))))
        met = met.unionByName(best_in_blocks(left, right, ["qb", "nb"], k)).groupBy("query_id", "vec_id").agg(F.max("near").alias("near"))

    order = Window.partitionBy("query_id")
    few = met.withColumn("_r", F.row_number().over(order.orderBy(F.desc("near"), "vec_id"))).where(F.col("_r") <= 2 * k)
    exact = few.select("query_id", "vec_id").join(rows.select(F.col("vec_id"), F.col("v").alias("_b")), "vec_id").join(
        rows.select(F.col("vec_id").alias("query_id"), F.col("v").alias("_a")), "query_id").select("query_id", "vec_id", dot("_a", "_b").alias("score"))
    ranked = exact.withColumn("rank", F.row_number().over(order.orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
