"""Runs against a search of every lag."""

from __future__ import annotations

import random

import numpy as np
import pytest

from remitloom.llm import arrays as A
from remitloom.llm import periodic, queries

from .conftest import LONG


def every_lag(words, least, times):
    found, n = [], len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(least, times * q) and i > start:
                found.append((start, i + q - start, q))
            i += i == start
    inside = lambda r: any(o[2] < r[2] and o[0] <= r[0] and o[0] + o[1] >= r[0] + r[1] for o in found)
    return sorted((r for r in found if not inside(r)), key=lambda r: (r[0], r[2]))


def some_words(rng):
    words = [rng.randrange(rng.choice([1, 2, 3, 30])) for _ in range(rng.randrange(0, 100))]
    for _ in range(rng.randrange(0, 4)):
        root = [rng.randrange(rng.choice([2, 3, 9])) for _ in range(rng.randrange(1, 25))]
        words += (root * 8)[:rng.randrange(1, 8 * len(root) + 1)]
    return words


@pytest.mark.parametrize("least,times", [(6, 4), (2, 3), (20, 4), (9, 3), (6, 7)])
def test_same_runs_as_every_lag(least, times):
    rng = random.Random(least)
    for _ in range(150):
        texts = [some_words(rng) for _ in range(rng.randrange(1, 4))]
        flat = A.mix(np.array([w for t in texts for w in t], np.uint64))
        got = periodic.runs_of(flat, np.cumsum([0, *map(len, texts)]), least, times)
        assert got.tolist() == [[k, *r] for k, t in enumerate(texts) for r in every_lag(t, least, times)]


def test_one_pair_a_position():
    """A hundred thousand equal words: one seed pair each in the first class, none later, one extension."""
    words, first = np.zeros(100_000, np.uint64), np.array([0, 100_000])
    assert sum(len(lag) for lag, _ in periodic.seeds(words, first, 6, 4)) < 100_000
    assert periodic.runs_of(words, first).tolist() == [[0, 0, 100_000, 1]]


def test_runs_and_what_is_left(spark, documents):
    rows = [(1, "a b a b a b a b c"), (2, "x\ty\nx y  x y x"), (3, "go " * 6), (4, "go " * 5), (5, None), (6, " \n"), (7, "p " + "q r s " * 40 + "t"), (7, "other text"),
            (None, "k " * 9), (8, LONG), (9, "Ä Ä Ä Ä Ä Ä é")]
    got = periodic.find(documents(rows)).collect()
    found = sorted([(r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got], key=lambda r: (r[0], r[1]))
    assert [(i, n, runs) for i, n, runs, _ in found] == [
        (0, 9, [(0, 9, 1)]), (1, 9, [(0, 8, 2)]), (2, 7, []), (3, 6, [(0, 6, 1)]), (4, 5, []), (5, 0, []), (6, 0, []), (7, 2, []), (7, 122, [(1, 120, 3)]),
        (8, 20_000, []), (9, 7, [(0, 6, 1)])]
    assert [t for *_, t in found][:8] == ["k", "a b c", "x y x y x y x", "go", "go go go go go", "", "", "other text"]
    assert found[8][3] == "p q r s t" and found[9][3] == LONG and found[10][3] == "Ä é"


def test_longest_of_equal_runs(spark, documents):
    got = periodic.find(documents([(1, "a a a a a a x b b b b b b")])).select(periodic.longest_run().alias("r")).first().r
    assert (-got.l, got.start, got.period) == (6, 0, 1)


def test_query_of_odd_rows(spark, odd, tmp_path):
    odd.drop("size", "part").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op12_periodic_runs(spark, str(tmp_path)).count() == odd.count()


def test_empty_table(spark, documents):
    assert periodic.find(documents([(1, "a")]).limit(0)).count() == 0


def test_too_few_periods(documents):
    with pytest.raises(ValueError):
        periodic.find(documents([(1, "a")]), times=2)
