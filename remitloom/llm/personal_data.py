"""Personal data: identifiers of known forms, and others found by their context.

Four kinds have a form that patterns describe (e-mail, IP address, card and
phone number).  They seed the search for identifiers of other forms: the one
and the two words before a seed are lexical patterns, and those that stand
before several different seeds in several documents are looked for in all
texts.  A pattern's instances are the words with a digit or an ``@`` behind it.
Pattern and instances form a graph on which Spark iterates: a pattern is as
sure as the share of all its places, of whatever follows, that hold a seed or
a believed instance; an instance is as sure as its patterns together (one
minus the product of their doubts).  Sure instances become spans of the kind
most seeds of their patterns have, unless they touch a span of known form.

A fifth kind, ``key``, has no known form.  Its seeds are words that look drawn
at random: ``KEY_LENGTH`` or more letters and digits that change places at least
three times, with three bits or more a character.  Such a word alone is nothing;
it counts where a pattern is sure of it.  Besides the words before it a key has
its shape as a pattern: four capitals it begins with, its length and its
characters.  So keys without a context are found by what they share, and less
random ones by the context or the shape that random ones have taught.  A word
ends behind ``:`` and ``=``; quotes and brackets before an identifier are passed
over.  Words of over 40 characters are no context, and none is looked for
further than 400 characters back: neither is a word that recurs.

Size: every pattern that qualifies is looked for, whatever their number.  A
pattern is known by the hash of its words; up to ``broadcast_patterns`` the
hashes, 8 bytes each, are sent to all tasks.  Beyond that the texts write the
hashes of all their contexts, counted by task, and of the places where a word
like an identifier follows, and these are joined to the patterns.

Defined cases: a null text is empty and has no spans; spans count code points,
the end is exclusive; rows that share an id are searched each by its own text.
"""

from __future__ import annotations

import re
from collections import Counter
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .scratch import freeze, map_arrow

KINDS = ("email", "ip", "card", "phone", "key")
KEY, KEY_LENGTH = 4, 12
_KEY = re.compile(r"[A-Za-z0-9+/_-]{%d,}" % KEY_LENGTH)
_CHANGES = re.compile(r"[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])")
_CAPITALS = re.compile(r"[A-Z]{4}")
_OPENING = "\"'([{<"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match of these can begin only where a run of digits begins, so no long run is read again from each of its digits.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MAYBE = re.compile(r"[0-9@]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
SPAN = "struct<kind:int,start:int,end:int>"


def luhn(digits: str) -> bool:
    doubled = [2 * int(d) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def emails(text: str):
    end = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            end = m.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of all spans of known form, by start, then kind."""
    if not _MAYBE.search(text):
        return []
    found = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in m.group().split(".")):
            found.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
                found.append((3, *m.span()))
    return sorted(found, key=lambda s: (s[1], s[0]))


def fold(word: str) -> str:
    return word.translate(_FOLDED)


_FOLDED = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_WORD = re.compile(r"[^\x20\x09-\x0D:=]*[:=]|[^\x20\x09-\x0D:=]+")


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``arrays.word_spans`` with a word's end behind every ``:`` and ``=``."""
    starts, ends, first = A.word_spans(data, offsets)
    marks = np.flatnonzero((data == ord(":")) | (data == ord("="))) + 1
    owner = np.searchsorted(starts, marks - 1, "right") - 1
    inner = marks[marks < ends[owner]] if len(marks) else marks
    if not len(inner):
        return starts, ends, first
    starts, ends = np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))
    return starts, ends, np.searchsorted(starts, offsets)


def random_looking(word: str) -> bool:
    """Letters and digits that change places three times or more, with three bits or more a character."""
    if len(_CHANGES.findall(word)) < 3:
        return False
    return -sum(n / len(word) * log2(n / len(word)) for n in Counter(word).values()) >= 3


def shape(word: str) -> str | None:
    """The shape of a word that begins with four capitals: those, its length and the kinds of its characters."""
    if len(word) < KEY_LENGTH or not _CAPITALS.match(word) or not _KEY.fullmatch(word):
        return None
    kinds = "".join(k for k, c in (("a", "[a-z]"), ("A", "[A-Z]"), ("0", "[0-9]"), ("-", "[^A-Za-z0-9]")) if re.search(c, word[4:]))
    return f"\x01{word[:4]}{len(word)}{kinds}"


def keys(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of random-looking words that touch no span of known form."""
    if not _MAYBE.search(text):
        return []
    found = [m.span() for m in _KEY.finditer(text) if random_looking(m.group())]
    return [(a, b) for a, b in found if not any(x < b and a < y for _, x, y in taken)]


def contexts(text: str, start: int, reach: int = 400) -> list[str]:
    """The word and the two words before a place, in lower case; words of at most 40 characters."""
    while start and text[start - 1] in _OPENING:
        start -= 1
    if start and not text[start - 1].isspace() and text[start - 1] not in ":=":
        return []
    words = [fold(w) for w in _WORD.findall(text[max(0, start - reach):start])[-2:]]
    return [] if not words or max(map(len, words)) > 40 else [words[-1]] + ([" ".join(words)] if len(words) == 2 else [])


def seeds(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, spans, seeds): spans of known form of every text, and (context, kind, instance) of each."""

    def run(batches):
        span, seed = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]), pa.struct(
            [("context", pa.string()), ("kind", pa.int32()), ("instance", pa.string())])
        for batch in batches:
            spans, told = [], []
            for text in batch.column(2).to_pylist():
                found = base_spans(text or "")
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
                own = [{"context": c, "kind": k, "instance": text[a:b]} for k, a, b in found for c in contexts(text, a)]
                for a, b in keys(text or "", found):
                    own += [{"context": c, "kind": KEY, "instance": text[a:b]} for c in [*contexts(text, a), shape(text[a:b])] if c]
                told.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.list_(span)), pa.array(told, pa.list_(seed))],
                                             ["doc_id", "tag", "spans", "seeds"])

    return map_arrow(docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, tag long, spans array<{SPAN}>, "
                                "seeds array<struct<context:string,kind:int,instance:string>>")


def induced(found: DataFrame, min_instances: int, min_docs: int) -> DataFrame:
    """(context, kind): contexts of several different seeds in several documents, with the kind most of those have."""
    each = found.select("doc_id", F.explode("seeds").alias("s")).select("doc_id", "s.*")
    by_kind = each.groupBy("context", "kind", "instance").agg(F.min("doc_id").alias("doc_id")).groupBy("context", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))
    total = by_kind.groupBy("context").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.max(F.struct("n", (-F.col("kind")).alias("k"))).alias("top"))
    return total.where((F.col("n") >= min_instances) & (F.col("docs") >= min_docs)).select(
        "context", (-F.col("top.k")).alias("kind"))


def pattern_keys(texts: list[str]) -> np.ndarray:
    """Hashes of contexts of one or two words, as ``occurrences`` makes them of texts."""
    out = np.zeros(len(texts), np.uint64)
    for at, _, data, offsets in A.chunks(pa.array(texts, pa.string())):
        starts, ends, first = A.word_spans(data, offsets)
        words, counts = A.span_hashes(data, starts, ends), np.diff(first)
        for size in (1, 2):
            own = np.flatnonzero(counts == size)
            if len(own):
                out[at + own] = A.window_hashes(words, size)[first[own]]
    return out


def with_keys(patterns: DataFrame) -> DataFrame:
    """(pattern, context, kind): ``patterns`` with their hashes."""

    def run(batches):
        for batch in batches:
            keys = pattern_keys(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column(0), batch.column(1)], ["pattern", "context", "kind"])

    return map_arrow(patterns.select("context", "kind"), run, "pattern long, context string, kind int")


def occurrences(docs: DataFrame, patterns: DataFrame, broadcast_patterns: int) -> DataFrame:
    """What follows each pattern anywhere: rows (pattern, n) of counts, and (pattern, doc_id, tag, start, end, instance) where it is like an identifier."""
    if patterns.count() > broadcast_patterns:
        return followed(docs, None).join(patterns.select("pattern").distinct(), "pattern", "left_semi")
    keys = np.unique(np.array([r["pattern"] for r in patterns.select("pattern").collect()], np.int64).view(np.uint64))
    return followed(docs, docs.sparkSession.sparkContext.broadcast(keys))


def identifier(data: np.ndarray, start: int, end: int) -> tuple[str, str]:
    """A word of a text's bytes, and the same without the quotes, brackets and stops around it."""
    raw = data[start:end].tobytes().decode("utf-8", "replace")
    return raw, raw.strip("\"'()[]{}<>,;:!?.")


def place(data: np.ndarray, text: int, start: int, raw: str, word: str) -> tuple[int, int]:
    """Where the identifier stands in its text, in code points."""
    begin = int(np.count_nonzero((data[text:start] & 0xC0) != 0x80)) + raw.index(word)
    return begin, begin + len(word)


def followed(docs: DataFrame, shared) -> DataFrame:
    """The rows of ``occurrences`` for the sorted hashes that ``shared`` broadcasts, or for every context."""

    def run(batches):
        seen, held, rows = [], 0, []
        for batch in batches:
            ids, tags = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, end, data, offsets in A.chunks(batch.column(2)):
                starts, ends, first = split_words(data, offsets)
                words = A.span_hashes(A.FOLD[data], starts, ends)
                owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
                like = np.concatenate([[0], np.cumsum(((data >= 48) & (data < 58)) | (data == 64))])
                like = like[ends] > like[starts]
                shaped = []
                for w in np.flatnonzero(like & (ends - starts >= KEY_LENGTH)).tolist():
                    raw, word = identifier(data, starts[w], ends[w])
                    form = shape(word)
                    if form:
                        shaped.append((w, raw, word, form))
                if shaped:
                    h = pattern_keys([form for *_, form in shaped])
                    hits = np.flatnonzero(known(h)) if shared is not None else np.arange(len(h))
                    seen.append(np.unique(h[hits], return_counts=True))
                    held += len(seen[-1][0])
                    for i in hits:
                        w, raw, word, _ = shaped[i]
                        rows.append((int(h[i].view(np.int64)), 0, ids[at + owner[w]], tags[at + owner[w]], *place(data, offsets[owner[w]], starts[w], raw, word), word))
                for size in (1, 2):
                    h = A.window_hashes(words, size)[:max(len(words) - size, 0)]  # a word follows
                    if not len(h):
                        continue
                    hits = owner[:len(h)] == owner[size:]
                    if shared is not None:
                        hits &= known(h)
                    hits = np.flatnonzero(hits)
                    seen.append(np.unique(h[hits], return_counts=True))
                    held += len(seen[-1][0])
                    for i in hits[like[hits + size]]:
                        w = i + size
                        doc = owner[w]
                        raw, word = identifier(data, starts[w], ends[w])
                        if len(word) < 5 or not _MAYBE.search(word):
                            continue
                        rows.append((int(h[i].view(np.int64)), 0, ids[at + doc], tags[at + doc], *place(data, offsets[doc], starts[w], raw, word), word))
                if held > 1 << 20:
                    yield counts(seen)
                    seen, held = [], 0
            yield from told(rows)
            rows = []
        if seen:
            yield counts(seen)

    def known(h):
        return shared.value[np.minimum(np.searchsorted(shared.value, h), len(shared.value) - 1)] == h

    def counts(seen):
        keys, back = np.unique(np.concatenate([k for k, _ in seen]), return_inverse=True)
        n = np.bincount(back, np.concatenate([n for _, n in seen]), len(keys)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n), *(pa.nulls(len(keys), t) for t in types[2:])], names)

    names = ["pattern", "n", "doc_id", "tag", "start", "end", "instance"]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string())

    def told(rows):
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names)

    return map_arrow(docs, run, "pattern long, n long, doc_id long, tag long, start int, end int, instance string")


def believed(edges: DataFrame, totals: DataFrame, seeds_: DataFrame, rounds: int) -> DataFrame:
    """(instance, belief, pattern) after the iterations; ``pattern``: the surest one it has.

    ``edges``: pattern and instance with n places, without seeds; ``totals``: pattern and all its places; ``seeds_``: pattern and
    places with a seed.
    """
    places = totals.join(seeds_, "pattern", "left").select("pattern", "total", F.coalesce("sown", F.lit(0)).alias("sown"))
    belief = edges.select("instance").distinct().withColumn("belief", F.lit(0.0)).withColumn("best", F.lit(0).cast("long"))
    for _ in range(rounds):
        mass = edges.join(belief, "instance").where("belief >= 0.5").groupBy("pattern").agg(F.sum(F.col("n") * F.col("belief")).alias("_mass"))
        sure = places.join(mass, "pattern", "left").select("pattern", (
            (F.col("sown") + F.coalesce("_mass", F.lit(0.0))) / (F.col("total") + 1.0)).alias("sure"))
        belief = freeze(edges.join(sure, "pattern").groupBy("instance").agg(
            (1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("sure"), F.lit(1e-9)))))).alias("belief"), F.max_by("pattern", "sure").alias("best")), "belief")
    return belief


def find(docs: DataFrame, min_instances: int = 5, min_docs: int = 3, rounds: int = 3, sure: float = 0.8, broadcast_patterns: int = 1_000_000) -> DataFrame:
    """(doc_id, spans, all_spans) for every row: spans of known form, and those with the discovered ones; by start, then kind."""
    tagged = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tag"), "text")
    found = freeze(seeds(tagged), "seeds")
    table = freeze(with_keys(induced(found, min_instances, min_docs)), "patterns")
    if table.isEmpty():
        return found.select("doc_id", "spans", F.col("spans").alias("all_spans"))
    seen = freeze(occurrences(tagged, table, broadcast_patterns), "occurrences")
    totals = seen.where("instance is null").groupBy("pattern").agg(F.sum("n").alias("total"))
    sown = found.select(F.explode("seeds").alias("s")).select("s.context").join(table, "context").groupBy("pattern").agg(F.count(F.lit(1)).alias("sown"))
    # instances that touch a span of known form are seeds already
    spans = found.where(F.size("spans") > 0).select(F.col("doc_id").alias("_d"), F.col("tag").alias("_t"), F.col("spans").alias("_spans"))
    free = seen.where("instance is not null").dropDuplicates(["pattern", "doc_id", "tag", "start"]).join(
        spans, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("tag") == F.col("_t")), "left").where(
        ~F.coalesce(F.exists("_spans", lambda s: (s["start"] < F.col("end")) & (s["end"] > F.col("start"))), F.lit(False)))
    free = freeze(free.select("pattern", "doc_id", "tag", "start", "end", "instance"), "instances")
    belief = believed(free.groupBy("pattern", "instance").agg(F.count(F.lit(1)).alias("n")), totals, sown, rounds)
    new = belief.where(F.col("belief") >= sure).join(table.select(F.col("pattern").alias("best"), "kind"), "best").select("instance", "kind")
    added = free.join(new, "instance").select("doc_id", "tag", F.struct("kind", "start", "end").alias("span")).distinct().groupBy(
        F.col("doc_id").alias("_d"), F.col("tag").alias("_t")).agg(F.collect_list("span").alias("_added"))
    ordered = F.transform(F.array_sort(F.transform(
        F.concat("spans", F.coalesce("_added", F.array().cast(f"array<{SPAN}>"))), lambda s: F.struct(s["start"], s["kind"], s["end"]))),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.join(added, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("tag") == F.col("_t")), "left").select(
        "doc_id", "spans", ordered.alias("all_spans"))
