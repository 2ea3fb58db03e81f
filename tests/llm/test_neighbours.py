"""Neighbours found by hashing against comparing all."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from remitloom.llm import neighbours as N
from remitloom.llm import queries


def brute(ids, x, wanted, k):
    out = {}
    for i in np.flatnonzero(wanted):
        near = [(-sum(a * b for a, b in zip(x[i], x[j])), ids[j]) for j in range(len(ids)) if j != i]
        out[ids[i]] = sorted(near)[:k]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((-r.score, r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(got, want):
    return np.mean([len({i for _, i in got.get(q, [])} & {i for _, i in w}) / len(w) for q, w in want.items()])


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_of_the_registered_query(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows])
    near = x[ids % 20 == 0] @ x.T
    near[ids[ids % 20 == 0][:, None] == ids[None, :]] = -9
    want = {q: [(0, i) for i in ids[np.argsort(-n, kind="stable")[:20]]] for q, n in zip(ids[ids % 20 == 0], near)}
    got = found(queries.op3_neighbours(spark, f"/root/testdata/{sf}"))
    assert set(got) == set(want) and all(len(g) == 20 for g in got.values()) and recall(got, want) >= 0.9


def test_lengths_ties_and_blocks(spark, monkeypatch):
    """Inner products of vectors of different lengths, a third of them the same one, in many small blocks."""
    monkeypatch.setattr(N, "BLOCK_ROWS", 64)
    monkeypatch.setattr(N, "BLOCK_QUERIES", 4)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 10)) * rng.uniform(0.2, 3, size=(600, 1))
    x[::3] = x[0]
    ids = np.arange(600) * 7 + 3
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got = found(N.search(df, F.col("vec_id") % 5 == 0, k=9))
    want = brute(ids.tolist(), x.tolist(), ids % 5 == 0, 9)
    assert set(got) == set(want) and recall(got, want) > 0.9
    for q in got:
        if x[ids == q][0].tolist() == x[0].tolist():
            assert got[q] == want[q]  # all ties, to the smallest ids


@pytest.mark.parametrize("n", [0, 1, 2, 12, 21])
def test_small_tables_give_all_candidates(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    got = found(N.search(df, F.col("vec_id") % 4 == 0, k=20))
    want = {q: w for q, w in brute(list(range(n)), df.toPandas()["embedding"].tolist() if n else [], np.arange(n) % 4 == 0, 20).items() if w}
    assert {q: [i for _, i in g] for q, g in got.items()} == {q: [i for _, i in w] for q, w in want.items()}


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0]), (8, []),
            (None, [1.0, 1.0]), (9, [-1.0, 0.0]), (9, [-2.0, 0.0]), (9, [-2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit("other")).withColumn("code", F.lit(1))
    got = found(N.search(df, F.col("vec_id") >= 0, k=20))
    assert got == {0: [(-0.5, 1), (2.0, 9)], 1: [(-0.5, 0), (1.0, 9)], 9: [(1.0, 1), (2.0, 0)]}


def test_more_rows_get_more_buckets_and_probes():
    assert N.hash_shape(64, 50_000, 512, 10) == ([128], 10)
    parts, probes = N.hash_shape(64, 10**8, 512, 10)
    assert len(parts) > 1 and 256 <= 10**8 / np.prod([2 * p for p in parts]) <= 1024 and probes > 100
