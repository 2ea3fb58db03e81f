"""Near-duplicates, repeated passages and repeated lines against plain loops."""

from __future__ import annotations

import hashlib
import random
import re
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from remitloom.llm import components, line_dups, near_dups, repeated_spans
from remitloom.llm.scratch import freeze

from .conftest import LONG, ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n):
    return [f"w{rng.randrange(400)}" for _ in range(n)]


def near_copies(seed=1, groups=4, copies=12, alone=30):
    """Groups around an original whose copies are near it but not always near each other, and texts that share a passage."""
    rng = random.Random(seed)
    texts = []
    passage = prose(rng, 60)
    for _ in range(groups):
        original = prose(rng, 120)
        texts.append(original)
        for _ in range(copies):
            copy = list(original)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(10**6)}"
            texts.append(copy)
    texts += [passage + prose(rng, rng.randrange(5, 60)) for _ in range(alone)]
    rng.shuffle(texts)
    return [(i * 3 + 1, " ".join(t)) for i, t in enumerate(texts)]


def brute_components(rows, size, num, den):
    sets = {}
    for doc, text in rows:
        w = [x.lower() for x in WORD.findall(text or "")]
        sets[doc] = {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize("small_bucket", [40, 1])
@pytest.mark.parametrize("size,num,den", [(3, 85, 100), (5, 80, 100)])
def test_components_as_by_comparing_all(spark, documents, monkeypatch, small_bucket, size, num, den):
    monkeypatch.setattr(near_dups, "SMALL_BUCKET", small_bucket)  # 1: all that hubs leave goes by rare shingles
    rows = near_copies() + [(1000, "A b  c"), (1001, "a B c"), (1002, "a"), (1003, "A"), (1004, ""), (1005, None), (1006, " \n")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dups.near_duplicates(documents(rows), shingle=size, num=num, den=den).collect()}
    assert got == brute_components(rows, size, num, den)


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 1200).astype(np.uint64)
    sets = [np.sort(pool[:1000]), np.sort(pool[200:]), pool[:1], pool[:0]]
    sketch = near_dups.sketches(sets, 512)
    assert (sketch[:3] != ~np.uint64(0)).all() and (sketch[3] == 0).all()
    assert abs((sketch[0] == sketch[1]).mean() - 800 / 1200) < 0.07


def test_odd_rows_of_near_duplicates(spark, odd):
    rows = near_dups.near_duplicates(odd, shingle=3, num=85, den=100).collect()
    assert len(rows) == len(ODD)
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert by[8][0].component_id == 1 and not by[8][0].kept and all(r.component_id is None and r.kept for r in by[None])
    assert [r.component_id for r in by[5]] == [5, 5] and by[2][0].n_shingles == 0 and by[2][0].component_id == 2
    kept = near_dups.one_of_each(odd, shingle=3, num=85, den=100)
    assert kept.columns == odd.columns and kept.where("doc_id = 8").count() == 0 and kept.where("doc_id = 5").count() == 2
    assert near_dups.near_duplicates(odd.limit(0)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(3, 3), (None, 4)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 7: 7, **{i: 7 for i in range(200, 260)}, 3: 3}


def brute_spans(rows, size):
    seen, out = defaultdict(set), {}
    words = [(d, WORD.findall(t or "")) for d, t in rows]
    for d, w in words:
        for i in range(len(w) - size + 1):
            seen[tuple(w[i:i + size])].add(d)
    for n, (d, w) in enumerate(words):
        gone = {j for i in range(len(w) - size + 1) if d is not None and any(x is not None and x < d for x in seen[tuple(w[i:i + size])])
                for j in range(i, i + size)}
        out[n] = (d, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest())
    return sorted(out.values(), key=str)


@pytest.mark.parametrize("size", [50, 7, 2])
def test_repeated_spans_as_by_comparing_all(spark, documents, size):
    rng = random.Random(size)
    rows = near_copies(seed=5, groups=2, copies=6, alone=12)
    rows += [(2000, rows[0][1] + " tail " + rows[3][1]), (2001, " ".join(prose(rng, 49))), (2002, rows[1][1]), (2002, rows[2][1]), (2002, rows[1][1]),
             (None, rows[0][1]), (2003, None), (2004, " ".join(["again"] * 120)), (2005, " ".join(["again"] * 60)), (2006, LONG), (2007, LONG + " end")]
    got = repeated_spans.without_repeats(documents(rows), size)
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()], key=str) == brute_spans(rows, size)


def test_passage_of_very_many_documents(spark, documents):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"own{i} {passage} end{i}") for i in range(400)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")  # a hash lies in several partitions
    try:
        got = {r.doc_id: r.n_removed for r in repeated_spans.without_repeats(documents(rows), 50).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {i: 60 * (i > 0) for i in range(400)}


def test_a_sketch_told_piece_by_piece_is_the_same(spark, documents, monkeypatch):
    """A task holds a bounded number of values; telling them in many pieces changes no counter."""
    assert repeated_spans.FLUSH <= 1 << 19
    docs = documents(near_copies(seed=9, groups=2, copies=4, alone=4)).coalesce(1)
    at_once = repeated_spans.merged_sketch(docs, 20)
    monkeypatch.setattr(repeated_spans, "FLUSH", 1)
    assert at_once.any() and np.array_equal(repeated_spans.merged_sketch(docs, 20), at_once)


def test_an_overfull_sketch_loses_nothing(spark, documents, monkeypatch):
    rows = near_copies(seed=9, groups=2, copies=4, alone=4)
    want = brute_spans(rows, 20)
    real = repeated_spans.merged_sketch
    monkeypatch.setattr(repeated_spans, "merged_sketch", lambda docs, size: np.full_like(real(docs, size), 255))
    got = repeated_spans.without_repeats(documents(rows), 20)
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()], key=str) == want


def test_least_of_neighbours_of_every_width():
    values = np.random.default_rng(2).integers(0, 99, 60)
    for width in range(1, 40):
        for n in range(61):
            want = [min(values[i:i + width]) for i in range(n - width + 1)]
            assert repeated_spans.sliding_least(values[:n], width).tolist() == want, (width, n)


def test_chunks_of_fewer_words_than_a_window(documents):
    rows = [(n, " ".join(f"s{i}" for i in range(n))) for n in range(44, 51)]
    big = " ".join(f"b{i}" for i in range(160_000))  # over 1 MiB: a chunk of its own, as what stands beside it then is
    rows += [(60, rows[2][1]), (61, big), (62, rows[3][1]), (63, rows[6][1])]
    got = repeated_spans.without_repeats(documents(rows).repartition(len(rows), "doc_id"), 50)
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()], key=str) == brute_spans(rows, 50)
    got = repeated_spans.without_repeats(documents(rows[-4:]).coalesce(1), 50)
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()], key=str) == brute_spans(rows[-4:], 50)


def test_odd_rows_of_spans(odd):
    got = repeated_spans.without_repeats(odd, 50)
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()], key=str) == brute_spans([r[:2] for r in ODD], 50)
    assert repeated_spans.without_repeats(odd.limit(0), 50).count() == 0


def brute_lines(rows, least, chars=1, policy="all"):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    docs, first = defaultdict(set), {}
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        for i, line in enumerate((t or "").split("\n")):
            docs[key(line)].add(d)
            first.setdefault(key(line), (d, i))
    goes = lambda d, i, line: len(key(line)) >= chars and len(docs[key(line)]) >= least and (policy == "all" or first[key(line)] != (d, i))
    return sorted([(d, "\n".join(line for i, line in enumerate((t or "").split("\n")) if not goes(d, i, line)) if t is not None else None) for d, t in rows], key=str)


LINES = [(i, f"Common line \n own {i}\n\ncommon LINE\t\n{'menu' if i % 2 else 'Menu'}\n{'menu' if i % 3 else 'x'}") for i in range(12)]


@pytest.mark.parametrize("policy", ["all", "later"])
@pytest.mark.parametrize("chars", [0, 1, 6])
def test_lines_as_by_counting(documents, policy, chars):
    got = line_dups.without_repeated_lines(documents(LINES), 10, chars, policy)
    assert sorted([(r.doc_id, r.text) for r in got.collect()], key=str) == brute_lines(LINES, 10, chars, policy)
    assert all(r.n_chars == len(r.text) for r in got.collect())


def test_line_bitmaps_are_sparse(documents):
    rows = [(i, "\n".join([f"l{i}-{k}" for k in range(1000)] + ["shared"])) for i in range(3)]
    got = line_dups.dropped_bitmaps(documents(rows), 3).collect()
    assert {r.doc_id: r.dropped for r in got} == {i: {15: 1 << (1000 % 64)} for i in range(3)}


def test_odd_rows_of_lines(odd):
    got = line_dups.without_repeated_lines(odd, 3)
    assert got.columns == odd.columns and got.count() == len(ODD)
    assert sorted([(r.doc_id, r.text) for r in got.collect()], key=str) == brute_lines([r[:2] for r in ODD], 3)
    assert line_dups.without_repeated_lines(odd.limit(0), 3).count() == 0
    repeated = line_dups.split_documents(odd.union(odd), 1, 1).where(F.size("kept") > 0)
    assert repeated.where("row.doc_id = 1").count() == 0


def test_a_chain_of_versions_takes_few_rounds(spark, monkeypatch):
    """Versions of one document, each linked with the next: rising ids, 2,000 links."""
    rounds = []
    monkeypatch.setattr(components, "freeze", lambda df, label: rounds.append(label) or freeze(df, label))
    edges = spark.range(2000).selectExpr("id as a", "id + 1 as b").union(spark.createDataFrame([(9001, 9002), (9002, 9001), (9003, 9003)], "a long, b long"))
    found = components.components(edges).groupBy("component").count().collect()
    assert sorted(map(tuple, found)) == [(0, 2001), (9001, 2), (9003, 1)]
    assert rounds.count("step") // 2 < 20


def test_one_text_of_many_repeated_lines(spark, documents):
    """Work grows with the lines: the text is hashed below the rows of its lines, and a line's bit is looked up at once."""
    text = "\n".join(["same", "x"] * 200_000 + ["end"])
    docs = documents([(1, text), (2, "same\nother"), (3, "same")])
    plan = line_dups.hashed_lines(docs, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("xxhash64(coalesce(text") and "text#" not in plan[:plan.index("Generate")].replace("text_id#", "")
    begin = time.perf_counter()
    rows = {r.row.doc_id: (len(r["lines"]), len(r.kept)) for r in line_dups.split_documents(docs, 2).collect()}
    assert rows == {1: (400_001, 200_001), 2: (2, 1), 3: (1, 0)} and time.perf_counter() - begin < 60


def test_dense_bitmap(spark):
    row = spark.sql("select map(3, 9L, 0, 5L, 6, 1L) as m, map_from_arrays(array(4), array(7L)) as n").select(line_dups.dense(F.col("m")).alias("m"), line_dups.dense(F.col("n")).alias("n")).first()
    assert row.m == [5, 0, 0, 9, 0, 0, 1] and row.n == [0, 0, 0, 0, 7]
