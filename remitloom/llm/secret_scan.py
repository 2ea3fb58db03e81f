"""Secrets in texts: credentials of known forms, and strings that are too new for the place they stand in.

Three kinds have a form that patterns describe: an assignment to a word such as
``password``, an access key and a long hexadecimal number (``KINDS``).  The
method adds spans of kind ``novel``.  A candidate is a run of 16 or more of the
characters keys are made of, with a digit, in a sensitive context: a word of
``CONTEXT`` ends at most ``GAP`` characters before it on its line, with nothing
but blanks, quotes, ``:``, ``=``, ``>`` and up to two short words between.

How new a candidate is, is measured by zstandard: the bytes it adds when the
compressor is primed with a dictionary of the words that stand around sensitive
places in the whole corpus, followed by the text around the candidate, from
which the candidate itself has been taken out.  A name that belongs to the text
or to common usage is mostly found in there; a random key is not.  A candidate
that adds at least ``NOVELTY`` bytes a character is reported, unless a base
span of another form than an assignment covers it already.

Size: texts are read once; what is kept of them are base spans and candidates
with ``AROUND`` characters on both sides.  Words of the dictionary are counted
by Spark over all of them, once a document, and the most frequent fill
``DICTIONARY`` bytes; that parameter of the method bounds what the driver and
the tasks hold.  Words with digits are left out, so that no secret which many
copies repeat makes itself known.

Defined cases: a null text is empty and has no spans; spans count code points,
the end is exclusive; rows that share an id are searched each by its own text;
if no text has a sensitive place, the dictionary is empty.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import freeze, map_arrow

KINDS = ("assign", "access", "hex", "novel")
# The base forms.
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
VALUE_LENGTH, ACCESS_LENGTH = 6, 20

# Words that make a place sensitive, and what may stand between one and the string it announces.
CONTEXT = ("password", "passwd", "passphrase", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "accesskey", "private_key",
           "credential", "credentials", "authorization", "bearer", "signature")
GAP = 24
#: Every word of a base form or a context holds one of these.
_HINTS = ("passw", "secret", "token", "key", "passphrase", "pwd", "credential", "authorization", "bearer", "signature")
_SENSITIVE = re.compile(rf"""(?:{'|'.join(sorted(CONTEXT, key=len, reverse=True))})(?=([\x20\t"'`:=>]+(?:[A-Za-z]{{1,8}}[\x20\t"'`:=>]+){{0,2}}))""",
                        re.IGNORECASE | re.ASCII)
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[A-Za-z_]{4,32}")
AROUND, DICTIONARY, NOVELTY = 512, 1 << 15, 0.75
SPAN = "struct<kind:int,start:int,end:int>"


def hinted(text: str) -> bool:
    low = text.lower()
    return any(h in low for h in _HINTS)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of all spans of known form, by start, then kind."""
    found = []
    if hinted(text):
        found += [(0, *m.span()) for m in _ASSIGN.finditer(text) if len(m.group(1)) >= VALUE_LENGTH]
    if "AKIA" in text:
        found += [(1, *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    found += [(2, *m.span()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], s[0]))


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of the strings in a sensitive context that no base span but an assignment's covers."""
    places = set()
    for m in _SENSITIVE.finditer(text) if hinted(text) else ():
        # the announced string follows at once, or after one or two of the short words, whichever begins a candidate first
        for at in (m.end() + k.end() for k in re.finditer(r"[\x20\t\"'`:=>]+", m.group(1))):
            if at - m.end() > GAP:
                break
            found = _CANDIDATE.match(text, at)
            if found and _DIGIT.search(found.group()):
                places.add(found.span())
                break
    covered = [(a, b) for kind, a, b in base if kind]
    return sorted(p for p in places if not any(a <= p[0] and p[1] <= b for a, b in covered))


def scan(docs: DataFrame, id_column: str) -> DataFrame:
    """(id, base, found) of every row; ``found``: start, end, value and the text around of each candidate."""
    span = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
    told = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("around", pa.string())])

    def run(batches):
        for batch in batches:
            spans, found = [], []
            for text in batch.column(1).to_pylist():
                base = base_spans(text or "")
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in base])
                found.append([{"start": a, "end": b, "value": text[a:b], "around": (text[max(0, a - AROUND):a] + " " + text[b:b + AROUND]).replace(text[a:b], " ")}
                              for a, b in candidates(text or "", base)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(span)), pa.array(found, pa.list_(told))], [id_column, "base", "found"])

    kind = docs.schema[id_column].dataType.simpleString()
    return map_arrow(docs.select(id_column, "text"), run, f"{id_column} {kind}, base array<{SPAN}>, found array<struct<start:int,end:int,value:string,around:string>>")


def dictionary(scanned: DataFrame, size: int = DICTIONARY) -> bytes:
    """The most frequent words around sensitive places, least frequent first, as zstandard reaches the end of a dictionary cheapest.

    A word counts once a document.  Only words that can be among the first
    ``size / 5`` leave the sort, each with its blank at least five bytes long.
    """
    words = scanned.where(F.size("found") > 0).select(F.explode(F.array_distinct(F.flatten(F.transform(
        "found", lambda f: F.regexp_extract_all(f["around"], F.lit(f"({_WORD.pattern})"), 1))))).alias("word"))
    ranked = words.groupBy("word").count().orderBy(F.desc("count"), "word").limit(size // 5)
    kept, used = [], 0
    for word, _ in ranked.collect():
        used += len(word) + 1
        if used > size:
            break
        kept.append(word)
    return " ".join(reversed(kept)).encode()


def novelty(value: str, around: str, known: bytes, level: int = 19) -> float:
    """Bytes a character that a string adds to a compressor that knows the words and the text around it."""
    import zstandard

    # a few bytes before, so that a dictionary of no words is one too
    primed = zstandard.ZstdCompressionDict(b"\n" * 8 + known + b"\n" + around.encode("utf-8", "replace"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    squeeze = zstandard.ZstdCompressor(level=level, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)
    return (len(squeeze.compress(value.encode())) - len(squeeze.compress(b""))) / max(1, len(value))


def find(docs: DataFrame, id_column: str = "doc_id", least: float = NOVELTY, size: int = DICTIONARY) -> DataFrame:
    """(id_column, base, spans) of every row: spans of known form, and all spans by start, then kind."""
    scanned = freeze(scan(docs, id_column), "secrets")
    known = scanned.sparkSession.sparkContext.broadcast(dictionary(scanned, size))
    span = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])

    def judge(batches):
        for batch in batches:
            spans = []
            for base, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                new = [{"kind": 3, "start": f["start"], "end": f["end"]} for f in found if novelty(f["value"], f["around"], known.value) >= least]
                spans.append(sorted(base + new, key=lambda s: (s["start"], s["kind"])) if new else base)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.list_(span))], [id_column, "base", "spans"])

    kind = docs.schema[id_column].dataType.simpleString()
    return map_arrow(scanned, judge, f"{id_column} {kind}, base array<{SPAN}>, spans array<{SPAN}>")
