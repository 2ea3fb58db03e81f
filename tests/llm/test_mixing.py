"""Targets and budgets of a mix against plain arithmetic."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from remitloom.llm import mixing

from .conftest import ODD


def shared_out(sizes: dict, weights=(5, 2, 1), share_pct=150, most=2):
    """Targets by giving the rest out again until no source is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = sum(sizes.values()) * share_pct / 100, set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not full:
            target |= {s: left * weight[s] / total for s in open_}
            break
        target |= {s: float(most * sizes[s]) for s in full}
        left -= sum(most * sizes[s] for s in full)
        open_ -= full
    return target


def corpus(seed):
    rng = random.Random(seed)
    sources = ["a", "B", "ä", None, "", "hot"]
    return [(i, " ".join(["w"] * rng.randrange(0, 40)), None, "hot" if i % 3 else rng.choice(sources)) for i in range(400)]


@pytest.mark.parametrize("seed", range(4))
def test_budgets_are_met_to_the_word(documents, seed):
    rows = corpus(seed)
    sizes = Counter()
    for _, text, _, source in rows:
        sizes[source] += len(text.split())
    want, taken = shared_out(sizes), Counter()
    for r in mixing.mix(documents(rows)).collect():
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(taken[s] == int(want[s] + 1e-9) for s in sizes)


def test_reruns_and_layouts_agree(documents):
    docs = documents(corpus(7))
    first = sorted(map(tuple, mixing.mix(docs).select("doc_id", "taken").collect()))
    assert first == sorted(map(tuple, mixing.mix(docs.repartition(13)).select("doc_id", "taken").collect()))


def test_documents_of_a_mix_come_near_the_budget(documents):
    rows = corpus(11)
    docs = documents(rows)
    target = {r.source: r.target for r in mixing.mix(docs).select("source", "target").distinct().collect()}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    got, times = defaultdict(int), Counter()
    for r in out.collect():
        got[r.source] += len(r.text.split())
        times[r.doc_id] += 1
    longest = max(len(t.split()) for _, t, _, _ in rows)
    assert all(target[s] - 1 <= got[s] <= target[s] + longest for s in target if target[s]) and max(times.values()) <= 2


@pytest.mark.parametrize("text", [lambda i: f"n{i} b c d e f g h i j", lambda i: "a b c d e f g h i j"])
def test_rows_without_id_keep_to_the_budget(documents, text):
    """Neither many texts without id nor many equal rows make a mix pass its budget by more than a document."""
    rows = [(i, f"w{i} b c d e f g h i j", None, "only") for i in range(20)] + [(None, text(i), None, "only") for i in range(200)]
    for share in (50, 141, 150):
        docs = documents(rows)
        got = mixing.mixed_documents(docs, share_pct=share)
        words = got.count() * 10
        assert 2200 * share / 100 - 1 <= words <= 2200 * share / 100 + 10
        assert sorted(map(repr, got.collect())) == sorted(map(repr, mixing.mixed_documents(docs.repartition(5), share_pct=share).collect()))


def test_equal_texts_that_differ_elsewhere(documents):
    rows = [(1, "a b c d", lang, "only") for lang in ("en", "de", "fr")] * 5
    got = Counter(r.lang for r in mixing.mixed_documents(documents(rows), share_pct=50).collect())
    assert sum(got.values()) == 8 and got == Counter(r.lang for r in mixing.mixed_documents(documents(rows[::-1]), share_pct=50).collect())


def test_weights_epochs_and_one_source(documents):
    rows = [(i, "a b c", None, "only") for i in range(10)]
    got = mixing.mix(documents(rows), weights=[3], share_pct=300, most=4).agg(F.sum("taken"), F.max("target")).first()
    assert got[0] == 90 and got[1] == 90.0


def test_odd_rows_of_a_mix(odd):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(ODD) and {r.size for r in rows if r.doc_id in (2, 3, 4)} == {0}
    assert mixing.mix(odd.limit(0)).count() == 0 and mixing.mixed_documents(odd.limit(0)).count() == 0
    assert mixing.mixed_documents(odd).where("doc_id in (2, 3, 4)").count() == 0
    assert mixing.mix(odd.where("text is null")).agg(F.sum("taken")).first()[0] == 0
