"""Ids against an independent Viterbi search, and back to texts."""

from __future__ import annotations

import random

import numpy as np
import pytest
from tokenizers import Tokenizer, models

from remitloom.llm import pieces
from remitloom.llm.queries import VOCABULARY

from .conftest import ODD

V = pieces.Vocabulary.load(VOCABULARY)
TEXTS = ["", " ", "a", "  two  spaces ", "x\n\ny", "\n", "日本語 text ▁z", "\U0001f600ab", "é" * 300, "the hend and " * 40, "▁▁a", "a\x00b\tc"]


@pytest.fixture(scope="module")
def encoder():
    return pieces.Encoder(V)


def ids(encoder, text):
    return np.frombuffer(encoder.encode(text), np.int32).tolist()


def total(id_list):
    worst = min(s for s, _ in V.scores.values()) - pieces.UNKNOWN_COST
    score = {i: s for s, i in V.scores.values()}
    return sum(score.get(i, worst) for i in id_list)


def test_as_good_as_another_implementation(encoder):
    """The same model in a library that keeps double precision; it knows no bytes for characters without a piece."""
    other = Tokenizer(models.Unigram([(p, s) for p, (s, i) in sorted(V.scores.items(), key=lambda x: x[1][1])], None, False))
    rank = {p: k for k, (p, _) in enumerate(sorted(V.scores.items(), key=lambda x: x[1][1]))}
    rng = random.Random(1)
    alphabet = "etaoinshrdlu    ,.-AEéüñß"
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60)))
        want = [V.scores[t][1] for t in other.encode("▁" + text.replace(" ", "▁")).tokens]
        got = ids(encoder, text)
        assert abs(total(got) - total(want)) < 1e-6 and rank
        assert b"".join(V.surfaces[i] for i in got) == b"".join(V.surfaces[i] for i in want)


def test_stream_window_and_whole_search_agree(encoder):
    rng = random.Random(2)
    for _ in range(100):
        text = "".join(rng.choice("▁▁aeioustrn日") for _ in range(rng.randrange(1, 400)))
        assert list(encoder.stream(text)) == encoder.within(text)


def test_stream_hands_out_early(encoder):
    seen = 0

    class Watched(str):
        def __getitem__(self, key):
            nonlocal seen
            if isinstance(key, slice):
                seen = max(seen, key.start or 0)
            return str.__getitem__(self, key)

    text = Watched("astonish" * 3000)
    lag = [seen - start for start, _, _ in encoder.stream(text)]
    assert max(lag[:-300]) <= 8 * encoder.longest  # never far behind what was read


@pytest.mark.parametrize("text", TEXTS + [r[1] for r in ODD if r[1]])
def test_round_trip(encoder, text):
    got = ids(encoder, text)
    assert encoder.decode(got).decode() == text.replace("▁", " ")


def test_words_cut_at_boundaries_give_the_ids_of_the_whole(encoder):
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice("ab  c\n▁the日") for _ in range(rng.randrange(1, 50)))
        assert encoder.encode(text) == (encoder.ids_of(("▁" + text).replace(" ", "▁")) if text else b"")


def test_without_byte_pieces_unknown_characters_join():
    bare = pieces.Encoder(V._replace(bytes_=[]))
    assert np.frombuffer(bare.encode("a \U00010330\U00010331 b"), np.int32).tolist().count(V.unknown) == 1


def test_odd_rows_of_encoding(odd):
    rows = pieces.encode(odd, V).collect()
    assert len(rows) == len(ODD)
    assert all((r.ids is None) == (r.exact is None) for r in rows) and all(r.exact for r in rows if r.ids is not None)
    assert {tuple(r.ids) for r in rows if r.doc_id == 3} == {()} and all(r.ids is None for r in rows if r.doc_id == 2)
    texts = sorted([(r.doc_id, r.text) for r in pieces.decode(pieces.encode(odd, V), V).collect()], key=str)
    assert texts == sorted([(d, t and t.replace("▁", " ")) for d, t, *_ in ODD], key=str)
    assert pieces.encode(odd.limit(0), V).count() == 0


def test_a_vocabulary_that_changes_texts_is_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.ParseFromString(open(VOCABULARY, "rb").read())
    model.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "m").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        pieces.Vocabulary.load(str(tmp_path / "m"))
