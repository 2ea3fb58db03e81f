"""Known forms against the plain patterns, and identifiers found by context."""

from __future__ import annotations

import random
import re

from remitloom.llm import personal_data as P
from remitloom.llm import queries

from .conftest import LONG, ODD


def plain(text):
    out = []
    for k, pattern in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                                 r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            total = sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits)))
            ok = (True, all(int(p) <= 255 for p in m.group().split(".")) if k == 1 else None,
                  12 <= len(digits) <= 19 and total % 10 == 0, 9 <= len(digits) <= 15)[k]
            if ok:
                out.append((k, *m.span()))
    return sorted(out, key=lambda s: (s[1], s[0]))


def test_known_forms_as_by_plain_patterns():
    rng = random.Random(3)
    parts = ["a@b.co", "x.y@", "@c.d", "@", ".", "-", " ", "+", "+1 (555) 123-4567", "4111 1111 1111 1111", "4111-1111-1111-1111", "1.2.3.4", "0300.1.1.1", "256",
             "999", "é", "a", "_", "%", "..", "0", "12", "--", "  ", "+49", "b-c.d-e", "\n", "٣", "1" * 13]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 9)))
        assert P.base_spans(text) == plain(text), text


def test_long_runs_take_no_time():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "+1" * 100_000, "a@" * 100_000, "1 " * 150_000, "@a." * 100_000):
        P.base_spans(text)


def test_contexts_find_other_forms(documents):
    rng = random.Random(1)
    noise = lambda n: " ".join(f"w{rng.choice('abcdefgh')}{rng.choice('ijklmn')}" for _ in range(n))
    rows = [(i, f"{noise(20)} my Phone: +1 555 01{i:02d} 99{i:02d}, {noise(10)}") for i in range(30)]
    rows += [(100 + i, f"{noise(8)} my phone: 0{i}55-77{i}1. {noise(8)}") for i in range(4)]  # no known form
    rows += [(200 + i, f"{noise(8)} version {i}55-77{i}1 {noise(8)} +1 555 01{i:02d} 98{i:02d}") for i in range(8)]
    out = {r.doc_id: r for r in P.find(documents(rows)).collect()}
    for i in range(4):
        (span,) = out[100 + i].all_spans
        assert out[100 + i].spans == [] and (span.kind, rows[30 + i][1][span.start:span.end]) == (3, f"0{i}55-77{i}1")
    assert all(r.spans == r.all_spans and len(r.spans) >= 1 for d, r in out.items() if not 100 <= d < 200)


def phones_behind_many_contexts(n):
    """Contexts that each stand before five seeds, then one that fewer seeds than theirs have; ids of other form behind that one."""
    rows = [(i, " ".join(f"{a}{k}x : +1 555 {i:03d} {k:04d} ." for k in range(n) for a in "q")) for i in range(6)]
    rows += [(100 + i, f"zebra zulu +1 555 77{i} 1234 and") for i in range(5)]
    return rows + [(200 + i, f"zebra zulu 0{i}55-77{i}1 and") for i in range(2)]


def test_every_pattern_is_looked_for(documents):
    """More patterns than the 20,000 that were once taken, all with more seeds than the one that counts."""
    out = {r.doc_id: r for r in P.find(documents(phones_behind_many_contexts(20_500))).collect()}
    for i in range(2):
        assert [(s.kind, s.start, s.end) for s in out[200 + i].all_spans] == [(3, 11, 20)] and out[200 + i].spans == []


def test_joined_patterns_find_the_same(documents, odd):
    docs = documents(phones_behind_many_contexts(50)).unionByName(odd)
    sent, joined = (sorted(map(str, P.find(docs, broadcast_patterns=n).collect())) for n in (1_000_000, 0))
    assert sent == joined and any("start=11, end=20" in r for r in sent)


def test_pattern_keys_are_those_of_texts():
    texts = ["phone:", "my phone:", "é", "x y"]
    for text, key in zip(texts, P.pattern_keys(texts)):
        words = P.A.span_hashes(*(lambda d, o: (d, *P.A.word_spans(d, o)[:2]))(*P.A.utf8(P.pa.array([text]))))
        assert P.A.window_hashes(words, len(words))[0] == key


def test_a_context_that_anything_follows_finds_nothing(documents):
    rows = [(i, f"the +1 555 01{i:02d} 99{i:02d} and the cat and the dog and the item-{i} or the bird") for i in range(30)]
    assert all(r.spans == r.all_spans for r in P.find(documents(rows)).collect())


def test_registered_columns_are_derived_from_spans(spark):
    from hashlib import sha256

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = queries.op5_personal_data(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(docs)
    for r in rows:
        spans = plain(docs[r.doc_id])
        text = ",".join(f"{P.KINDS[k]}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == sha256(text.encode()).hexdigest() and set(filter(None, text.split(","))) <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for k, _, _ in spans) for j in range(4)]


def test_odd_rows_of_personal_data(odd, documents):
    rows = P.find(odd).collect()
    assert len(rows) == len(ODD) and all(r.spans == [] for r in rows)
    assert P.find(odd.limit(0)).count() == 0
    mixed = documents([(1, "a@b.co"), (1, "é c@d.org"), (None, "e@f.net"), (2, LONG + " g@h.info")])
    got = sorted(((r.doc_id, r.spans[0].start) for r in P.find(mixed).collect()), key=str)
    assert got == sorted([(1, 0), (1, 2), (None, 0), (2, len(LONG) + 1)], key=str)


def some_key(rng, n=24):
    return "".join(rng.choice("0123456789abcdef") for _ in range(n))


def test_keys_teach_their_contexts_and_shapes(documents):
    """Random-looking words teach the words and heads before them and their shape; those find less random ones."""
    rng = random.Random(3)
    noise = lambda n: " ".join(f"w{rng.choice('abcdefgh')}{rng.choice('ijklmn')}" for _ in range(n))
    account = lambda: "ACME" + "".join(rng.choice("ABCDEFGH0123456789") for _ in range(12))
    rows = [(i, f'{noise(9)} pin = "{some_key(rng)}" {noise(5)}') for i in range(8)]
    rows += [(20 + i, f"{noise(9)} Entry={some_key(rng, 18)} {noise(5)}") for i in range(8)]
    rows += [(40 + i, f"{noise(9)} {account()} {noise(5)}") for i in range(30)]
    rows += [(100, f'{noise(4)} pin = "hunter2000" {noise(4)}'), (101, f"{noise(4)} entry=summer2024 x"), (102, f"{noise(4)} ACMEAAAAAAAAAAA7. x")]
    rows += [(200 + i, f"{noise(9)} {some_key(rng)} {noise(5)} and the summer2024 of ACMES and items 12345678901234") for i in range(8)]
    rows += [(300, "plain words only"), (301, None)]
    texts = dict(rows)
    out = {r.doc_id: [(P.KINDS[s.kind], texts[r.doc_id][s.start:s.end]) for s in r.all_spans] for r in P.find(documents(rows)).collect()}
    assert out[100] == [("key", "hunter2000")] and out[101] == [("key", "summer2024")] and out[102] == [("key", "ACMEAAAAAAAAAAA7")]
    assert all(len(out[i]) == 1 for i in (*range(8), *range(20, 28), *range(40, 70)))
    assert all(out[i] == [] for i in (*range(200, 208), 300, 301))


def test_planted_secrets_are_found_and_clean_texts_left(spark):
    """On the given table: all spans beyond the base are keys, every document with a planted secret has one, no other document."""
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").collect()}
    rows = queries.op5_personal_data(spark, "/root/testdata/sf0.1").collect()
    planted = {d for d, t in docs.items() if re.search(r'(?i:token = "[0-9a-f]{40}")|password=[0-9a-f]{18}|AKIA[A-Z0-9]{16}', t)}
    found = {r.doc_id for r in rows if "key:" in r.spans}
    assert len(planted) > 100 and len(planted - found) <= 0.02 * len(planted) and not found - planted


def test_words_end_behind_signs():
    data, offsets = P.A.utf8(P.pa.array(["a=b: c ::d", "", "x:", "é=1"]))
    starts, ends, first = P.split_words(data, offsets)
    assert [data[a:b].tobytes().decode() for a, b in zip(starts, ends)] == ["a=", "b:", "c", ":", ":", "d", "x:", "é=", "1"]
    assert first.tolist() == [0, 6, 6, 7, 9]
    assert [P._WORD.findall(t) for t in ("a=b: c ::d", "é=1")] == [["a=", "b:", "c", ":", ":", "d"], ["é=", "1"]]
