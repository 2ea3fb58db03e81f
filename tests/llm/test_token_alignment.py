"""Groups, links and counts against both tokenizers run text by text."""

from __future__ import annotations

import collections
import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from remitloom.llm import token_alignment
from remitloom.llm.queries import BYTE_VOCABULARY, VOCABULARY, op13_token_alignment

from .conftest import LONG, ODD, SF

BOTH = token_alignment.Tokenizers.load(BYTE_VOCABULARY, VOCABULARY)


def plainly(texts):
    a = Tokenizer.from_file(BYTE_VOCABULARY)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=VOCABULARY)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    value = {chr(c): c for c in printable}
    value |= {chr(256 + n): c for n, c in enumerate(c for c in range(256) if c not in printable)}
    rows, linked = [], []
    for text in texts:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(value[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        links, groups = [], []
        if text and b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            ends_a, ends_b = (np.cumsum([len(x) for x in s]).tolist() for s in (bytes_a, bytes_b))
            at_a = at_b = 0
            for cut in sorted(set(ends_a) & set(ends_b)):
                to_a, to_b = ends_a.index(cut, at_a) + 1, ends_b.index(cut, at_b) + 1
                own_a, own_b, at_a, at_b = ids_a[at_a:to_a], ids_b[at_b:to_b], to_a, to_b
                groups.append(",".join(map(str, own_a)) + "|" + ",".join(map(str, own_b)))
                links += [(x, y) for x in own_a for y in own_b]
            rows.append([len(ids_a), len(ids_b), len(groups), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest()])
        else:
            rows.append([0, 0, 0, 0, ""])
        linked.append(links)
    held = collections.Counter(pair for links in linked for pair in set(links))
    top = collections.Counter()
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    return [(*r[:4], sum(held[p] == top[p[0]] for p in links), sum(held[p] for p in links), r[4]) for r, links in zip(rows, linked)]


def aligned(df, **options):
    return [tuple(r)[1:] for r in sorted(token_alignment.align(df, BOTH, **options).collect(), key=lambda r: r.doc_id)]


def awkward(n):
    rng = random.Random(2)
    bits = ["a", "b", "the ", "tion", " ", "  ", "\n", "\t", "é", "日", "\U0001f600", "▁", "<s>", "</s>", "<|endoftext|>", "<0x0A>", "1", "2.5", "'s", "\r", "\xa0", "　", "ñ",
            "ß", ".", "=", "\x00", "‍", "\x85", " \n", " x"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("block_bytes", [1, 2000, 1 << 20])
def test_same_as_text_by_text(spark, documents, block_bytes):
    texts = awkward(400) + [" " * 50 + "x", "é" * 100, "the hend " * 300, "a ", " a", "", LONG]
    assert aligned(documents(list(enumerate(texts))).repartition(3), block_bytes=block_bytes) == plainly(texts)


def test_vocabularies_without_boundaries(spark, documents):
    texts = awkward(60)
    got = token_alignment.align(documents(list(enumerate(texts))), BOTH._replace(by_words=False))
    assert [tuple(r)[1:] for r in sorted(got.collect(), key=lambda r: r.doc_id)] == plainly(texts)


def test_whole_table(spark):
    rows = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    got = sorted(tuple(r) for r in op13_token_alignment(spark, SF).collect())
    assert got == [(r.doc_id, *want) for r, want in zip(rows, plainly([r.text for r in rows]))]


def test_ends_are_counted_on_where_offsets_are_not_sure():
    """Three tokens of one character of three bytes, then one sure token."""
    ends = token_alignment.byte_ends(np.array([1, 2, 2, 2, 3]), np.array([True, False, False, True, True]), np.array([1, 1, 1, 1, 1]), np.array([0, 1, 4, 5]))
    assert ends.tolist() == [1, 2, 3, 4, 5]


def test_pack():
    columns = [np.array([], np.int64), np.array([0, 300]), np.array([1 << 40])]
    assert [c.tolist() for c in token_alignment.unpack(token_alignment.pack(*columns))] == [[], [0, 300], [1 << 40]]


def test_odd_rows(spark, odd):
    got = token_alignment.align(odd, BOTH).collect()
    assert len(got) == len(ODD) and sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in ODD)
    texts = [r[1] or "" for r in ODD]
    assert sorted(tuple(r)[1:] for r in got) == sorted(plainly(texts))
    assert token_alignment.align(odd.limit(0), BOTH).count() == 0
