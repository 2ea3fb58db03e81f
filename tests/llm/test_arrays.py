"""Words and hashes of many texts at once against one text at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from remitloom.llm import arrays as A

TEXTS = st.lists(st.text(st.sampled_from("abAZé \t\n\x0b\x1c 日"), max_size=30), max_size=8)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_words_are_the_runs_outside_white_space(texts):
    data, offsets = A.utf8(pa.array(texts, pa.string()))
    starts, ends, first = A.word_spans(data[offsets[0]:], offsets - offsets[0]) if len(texts) else ([], [], [0])
    for i, text in enumerate(texts):
        got = [data[offsets[0] + a:offsets[0] + b].tobytes() for a, b in zip(starts[first[i]:first[i + 1]], ends[first[i]:first[i + 1]])]
        assert got == text.encode().split()


def test_hashes_tell_words_apart_and_nothing_else():
    words = sorted({f"{a}{b}{i}" for a in "abc" for b in ("", "x", "xx") for i in range(500)})
    data, offsets = A.utf8(pa.array([" ".join(words + words[::-1])]))
    starts, ends, _ = A.word_spans(data, offsets)
    hashes = A.span_hashes(data, starts, ends)
    assert len(set(hashes.tolist())) == len(words)
    assert (hashes[:len(words)] == hashes[len(words):][::-1]).all()
    windows = A.window_hashes(np.concatenate([hashes[:100], hashes[50:100]]), 7)
    assert len(set(windows.tolist())) == len(windows) - 44  # those of the repeated fifty


def test_chunks_cover_a_sliced_column():
    column = pa.array(["skip", "a b", None, "", "c" * 10, "d"]).slice(1)
    found = [data[offsets[i]:offsets[i + 1]].tobytes() for at, end, data, offsets in A.chunks(column) for i in range(end - at)]
    assert found == [b"a b", b"", b"", b"c" * 10, b"d"]
