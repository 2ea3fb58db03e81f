"""Kneser-Ney models and what they say of texts."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from remitloom.llm import arrays as A
from remitloom.llm import languages as L

from .conftest import ODD, SF


def fitted(texts):
    langs = sorted({lang for lang, _ in texts})
    own, run = [], []
    for lang, text in texts:
        found = L.runs(*A.utf8(pa.array([text])))[0]
        run.append(found)
        own.append(np.full(len(found), langs.index(lang)))
    pairs, n = np.unique(np.stack([np.concatenate(own).astype(np.uint64), np.concatenate(run)]), axis=1, return_counts=True)
    return L.Models.fit(langs, pairs[0].astype(int), pairs[1], n)


def test_runs_are_lower_case_letters_with_single_spaces():
    runs, first = L.runs(*A.utf8(pa.array(["", "A--b", None, " é9", "..."])))
    shown = ["".join(chr(int(r) >> 16 * k & 0xFFFF) for k in (3, 2, 1, 0)) for r in runs]
    assert shown == ["   a", "  a ", " a b", "   é", "  é "] and first.tolist() == [0, 0, 3, 3, 5, 5]


def test_probabilities_sum_to_one():
    model = fitted([("x", "abab abba baab aabb"), ("y", "cacb ccab bcab")])
    alphabet = [ord(c) for c in "abc "] + [ord("z")]  # z stands for what no text had
    for context in itertools.product(alphabet[:4], repeat=3):
        grams = np.array([(context[0] << 48) | (context[1] << 32) | (context[2] << 16) | c for c in alphabet], np.uint64)
        assert np.allclose(np.exp(model.score(grams).astype(float)).sum(axis=0), 1, atol=1e-5), context


def test_a_seen_run_is_likelier_than_an_unseen_one():
    model = fitted([("x", "the cat the hat the bat"), ("y", "der hut der gut der mut")])
    e, _, _ = model.cross_entropies(*A.utf8(pa.array(["the rat", "der hund"])))
    assert e[0, 0] < e[0, 1] and e[1, 1] < e[1, 0]


def test_accuracy_on_documents_not_learned_from(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    out = L.identify(docs, docs.where(~L.held_out(F.col("doc_id")))).join(docs.select("doc_id", "lang"), "doc_id")
    held = out.where(L.held_out(F.col("doc_id"))).collect()
    assert len(held) > 100 and np.mean([r.lang == r.lang_pred for r in held]) > 0.97 and all(0 <= r.score <= 1 for r in held)
    assert np.mean([r.rejected for r in held]) < 0.1


def test_foreign_text_is_rejected(spark, documents):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    odd = documents([(1, "ζωη μου σας αγαπω " * 30), (2, "xqzj wvkx qqzx jjkq " * 30)])
    assert all(r.rejected for r in L.identify(odd, docs).collect())


def test_odd_rows_of_languages(odd):
    rows = L.identify(odd, odd).collect()
    assert len(rows) == len(ODD)
    assert {(r.lang_pred, r.score) for r in rows if r.doc_id in (2, 3, 4)} == {("und", 0.0)} and all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in L.identify(odd, odd.limit(0)).collect()} == {"und"} and L.identify(odd.limit(0), odd).count() == 0


def test_models_as_tables_say_the_same(spark, odd, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 100_000)  # several blocks
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for texts, training in ((docs.unionByName(odd.select(*docs.columns)), docs.where(~L.held_out(F.col("doc_id")))), (odd, odd)):
        want, got = ([(r.doc_id, r.lang_pred, r.score, r.cross_entropy, r.rejected) for r in L.identify(texts, training, broadcast_cells=n).collect()]
                     for n in (1 << 22, 0))
        known = lambda rows: sorted([r for r in rows if r[3] is not None], key=lambda r: (str(r[0]), round(r[3], 3)))
        assert len(got) == len(want) and sorted(map(str, (r for r in got if r[3] is None))) == sorted(map(str, (r for r in want if r[3] is None)))
        assert [r[:2] + r[4:] for r in known(got)] == [r[:2] + r[4:] for r in known(want)]
        assert np.allclose([r[2:4] for r in known(got)], [r[2:4] for r in known(want)], atol=1e-4)


def test_no_run_is_left_out(documents):
    """More different runs than the 200,000 that were once kept: a text of runs seen only once still teaches."""
    rng = np.random.default_rng(4)
    odd_text = lambda n: "".join(chr(0x4E00 + c) for c in rng.integers(0, 5000, n))
    rows = [(i, odd_text(10_000) + " ", "zh", None) for i in range(30)]
    rows = [(d, t * 2, *rest) for d, t, *rest in rows] + [(100 + i, odd_text(2_000), "zh", None) for i in range(6)]
    docs = documents(rows + [(200, "die katze und der hund " * 20, "de", None)])
    learned = {r.doc_id for r in docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(16)) != 0).collect()}
    assert L.counted(docs.where(F.col("doc_id").isin(*learned))).where("lang = 'zh' and n > 1").count() > 205_000
    rare = [r.cross_entropy for r in L.identify(docs, docs).where("doc_id between 100 and 105").collect() if r.doc_id in learned]
    assert len(rare) > 2 and max(rare) < 1
