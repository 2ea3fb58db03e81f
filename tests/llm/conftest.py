from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"
DOCS = ("doc_id long, text string, lang string, source string, n_chars long, h1 long, size string, part string, component_id string, kept string, "
        "tag string, n_words string, row string, lines string")


@pytest.fixture
def documents(spark):
    """(doc_id, text[, lang[, source]]) rows as a documents table with further columns whose names operators use inside."""
    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, len(r[1] or ""), 7, "s", "p", "c", "k", "t", "w", "r", "l")
                for r in rows]
        return spark.createDataFrame(full, DOCS)
    return make


LONG = " ".join(f"w{i}" for i in range(20_000))
ODD = [
    (1, "One fine day the cat sat on the mat and looked at the dog.\nA second line.", "en", "a"),
    (2, None, "en", "a"), (3, "", "de", None), (4, " \t\n\x0b ", None, "b"), (5, LONG, "en", "b"), (5, LONG, "en", "b"),
    (6, "x", "fr", "c"), (7, "x" * 30_000, "en", "c"), (None, "no id here, but words", "en", None), (None, None, None, None),
    (8, "One fine day the cat sat on the mat and looked at the dog.\nA second line.", "en", "a"), (8, "the same id with another text", "en", "a"),
    (9, "Grüße \U0001f600 ▁ 日本語\nA second line.", "de", "d"),
]


@pytest.fixture
def odd(documents):
    return documents(ODD)


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 0), (5, 1, None), (6, 0, 0), (7, 0, 1), (None, 1, 0), (99, 1, 0), (8, None, None)],
                                 "doc_id long, quality int, toxic int")
