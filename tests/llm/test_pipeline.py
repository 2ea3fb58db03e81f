"""The pipeline's stages on their own input, and together against a plain version."""

from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline as C
from remitloom.llm import pieces

from .conftest import ODD, SF
from .test_dedup import brute_components, brute_lines
from .test_mixing import shared_out
from .test_quality import brute


@pytest.fixture
def folder(labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name,stage", C.STAGES[:-1])
def test_stages_keep_the_columns_and_take_odd_rows(spark, odd, folder, name, stage):
    out = stage(spark, odd, folder)
    assert out.columns == odd.columns and out.schema["doc_id"].dataType == odd.schema["doc_id"].dataType
    assert out.count() <= 2 * len(ODD)
    assert stage(spark, odd.limit(0), folder).count() == 0


def test_last_stage_takes_odd_rows(spark, odd, folder):
    assert C.STAGES[-1][1](spark, odd, folder).count() == len(ODD) and C.STAGES[-1][1](spark, odd.limit(0), folder).count() == 0


def test_stages_in_order():
    assert [n for n, _ in C.STAGES] == ["quality rules", "line dedup", "near-duplicates", "mixing", "sentencepiece"]


def test_run_as_by_a_plain_version(spark):
    """With the few labels of the small table no cutoff can be certified, so only the base rule rejects."""
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    good = [(d, t, s) for d, t, s in docs for n, _, _, _, rep in [brute(t)] if n >= 50 and 100 * rep <= 50 * n]
    texts = dict(brute_lines([(d, t) for d, t, _ in good], C.MIN_DOCS_OF_A_LINE))
    parts = brute_components(list(texts.items()), 5, 80, 100)
    kept = [(d, texts[d], s) for d, _, s in good if parts[d][1] == d]
    sizes = Counter()
    for _, t, s in kept:
        sizes[s] += len(t.split())
    targets, longest = shared_out(sizes), max(len(t.split()) for _, t, _ in kept)
    got, words = Counter(), Counter()
    encoder = pieces.Encoder(pieces.Vocabulary.load(C.VOCABULARY))
    for r in C.run(spark, SF).collect():
        assert r.exact and encoder.decode(r.ids).decode() == texts[r.doc_id]
        got[r.doc_id] += 1
        words[r.source] += len(texts[r.doc_id].split())
    assert set(got) <= {d for d, _, _ in kept} and max(got.values()) <= 2
    assert all(targets[s] - 1 <= words[s] <= targets[s] + longest for s in targets)
