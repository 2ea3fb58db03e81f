"""Base forms against plain patterns, and strings too new for their place."""

from __future__ import annotations

import random
import re

from remitloom.llm import queries, secret_scan

from .conftest import ODD

KEY = "kX93_fQz71LmPa08+Vw2"
HEX = "4d44c79e8bf7c55759c4958dd60ed83d2ef8cd4e"


def plain(text):
    forms = [(0, r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), (1, r"(AKIA[A-Z0-9]+)"), (2, r"([0-9a-f]+)")]
    least = (6, 20, 24)
    found = [(k, *m.span()) for k, form in forms for m in re.finditer(form, text, re.ASCII) if len(m.group(1)) >= least[k]]
    return sorted(found, key=lambda s: (s[1], s[0]))


def test_base_spans_of_random_texts():
    rng = random.Random(4)
    bits = ["password", "PassWd", "token", "ſecret", "secret", "api_key", "ApiKey", "apiKey", " ", "=", ":", "'", '"', "abc123", "AKIA", "ABCDEFGHIJKLMNOP1", HEX, "\n", "é", "x" * 6]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 14)))
        assert secret_scan.base_spans(text) == plain(text), text



def spans(spark, documents, texts):
    rows = secret_scan.find(documents(list(enumerate(texts)))).collect()
    return [[(secret_scan.KINDS[s.kind], texts[r.doc_id][s.start:s.end]) for s in r.spans] for r in sorted(rows, key=lambda r: r.doc_id)]


def test_new_strings_in_sensitive_places(spark, documents):
    got = spans(spark, documents, [
        f"Authorization: Bearer {KEY} and more", f"the password is {KEY}.", f"é password={KEY}", f"a credential\n{KEY}", f"no word before it {KEY}",
        "the token is configuration_manager_2 of the configuration_manager_2 here: configuration_manager", f'token = "{HEX}" end', "the token is shortkey1",
        f"the secret and the whole long sentence that goes on {KEY}"])
    assert got[0] == [("novel", KEY)] and got[1] == [("novel", KEY + ".")]
    assert got[2] == [("assign", f"password={KEY}"), ("novel", KEY)]
    assert got[3] == got[4] == got[7] == got[8] == []
    assert [k for k, _ in got[6]] == ["assign", "hex"]


def test_known_names_are_not_new(spark, documents):
    usage = [f"load customer_session_handler_v{i % 7} before the token: it belongs to customer_session_handler and is no token" for i in range(40)]
    named = "the token: customer_session_handler_v3 is one of customer_session_handler_v1 and customer_session_handler_v2"
    got = spans(spark, documents, [*usage, named, f"the token: {KEY} stands there"])
    assert not any(k == "novel" for k, _ in got[40]) and ("novel", KEY) in got[41]


def test_copies_do_not_make_a_secret_known(spark, documents):
    got = spans(spark, documents, [f"Authorization: Bearer {KEY} x {KEY}"] * 60)
    assert all(("novel", KEY) in g for g in got)


def test_novelty_falls_with_what_is_known():
    name = "customer_session_handler1"
    assert secret_scan.novelty(name, "", b"") > secret_scan.novelty(name, "", b"customer session handler") > secret_scan.novelty(name, "customer_session_handler2", b"")
    assert secret_scan.novelty(KEY, "customer", b"session") > 0.9


def test_odd_rows(spark, odd):
    got = secret_scan.find(odd).collect()
    assert len(got) == len(ODD) and all(r.base == [] and r.spans == [] for r in got)
    assert secret_scan.find(odd.limit(0)).count() == 0


def test_query_keeps_base_columns(spark):
    import hashlib

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    texts = {r.doc_id: r.text or "" for r in docs}
    rows = queries.op11_secrets(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(docs) and any(r.spans for r in rows)
    for r in rows:
        base = plain(texts[r.doc_id])
        written = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(written.encode()).hexdigest() and (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for k, *_ in base) for i in range(3))
        assert set(written.split(",")) <= set(r.spans.split(","))
