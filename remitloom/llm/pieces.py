"""Encoding texts to SentencePiece ids by a streaming Viterbi search, and decoding them.

The best segmentation maximises the sum of the pieces' scores.  The search goes
through a text once.  It keeps, for the ends of pieces that are still open, the
best score and where the last piece began; pieces are short, so that is a
window of the longest piece.  Whenever all paths that are still alive go
through one boundary, the ids up to it are final: they are handed out and
forgotten, so memory does not grow with the text.  Where no piece reaches over
a place that is such a boundary for every text: before a space after a word.
A word's ids are remembered there, for up to twice ``REMEMBER`` words a task.

Ties: of equally good segmentations the one whose last piece is longest, at
every boundary.  A character that no piece covers becomes its UTF-8 bytes if
the vocabulary has byte pieces, else the unknown id.  Such a character costs 10
more than the worst piece.

Only vocabularies without a text normalisation table and without user-defined
pieces are read.  A space stands for the piece character U+2581, so a text's
own U+2581 comes back as a space; apart from that decoding returns the text.

Defined cases: a null text has null ids; an empty one has none.
"""

from __future__ import annotations

import re
from array import array
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .scratch import map_arrow

SPACE = "▁"
REMEMBER, LONG_WORD = 400_000, 64
UNKNOWN_COST = 10.0


class Vocabulary(NamedTuple):
    """What encoding and decoding need of a model file: some ten bytes for each of its pieces."""

    scores: dict[str, tuple[float, int]]
    surfaces: list[bytes]
    bytes_: list[int]
    unknown: int
    prefix: bool

    @classmethod
    def load(cls, path: str) -> "Vocabulary":
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or any(p.type == 4 for p in model.pieces):
            raise ValueError(f"{path}: a vocabulary that changes texts or has user-defined pieces")
        kinds = [p.type for p in model.pieces]
        scores = {p.piece: (p.score, i) for i, p in enumerate(model.pieces) if p.type in (1, 5)}
        own = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        surface = lambda p: bytes([int(p.piece[1:-1], 16)]) if p.type == 6 else p.piece.replace(SPACE, " ").encode() if p.type in (1, 5) else (
            " ⁇ ".encode() if p.type == 2 else b"")
        return cls(scores, [surface(p) for p in model.pieces], [own[b] for b in range(256)] if len(own) == 256 else [], kinds.index(2), norm.add_dummy_prefix)


class Encoder:
    """Ids of texts; one per task."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.heads = {piece[:k] for piece in vocabulary.scores for k in range(1, len(piece) + 1)}
        self.tree: dict = {}  # by characters; under "" the score and id of the piece that ends there
        for piece, found in vocabulary.scores.items():
            node = self.tree
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = found
        self.longest = max(map(len, vocabulary.scores))
        self.worst = min(score for score, _ in vocabulary.scores.values()) - UNKNOWN_COST
        # a boundary for every text: no piece has the space behind another character, none has a line end
        self.by_words = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in vocabulary.scores) and bool(vocabulary.bytes_)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.line_end = self.ids_of("\n") if self.by_words else b""

    def stream(self, text: str):
        """Ids of a text with spaces replaced, piece by piece as they become final."""
        scores, heads, n = self.v.scores, self.heads, len(text)
        best, back, done = {0: 0.0}, {}, 0

        def path(to):
            ids = []
            while to > done:
                start, id_ = back[to]
                ids.append((start, to, id_))
                to = start
            return ids[::-1]

        for at in range(n):
            if not at or at not in back:
                if at:
                    continue  # no path ends here
            elif not best.keys() - {at}:
                yield from path(at)  # the only end alive: all paths meet here
                back.clear()
                done = at
            elif len(back) > 4 * self.longest:
                alive = set(best)
                while len(alive) > 1:
                    last = max(alive)
                    alive.discard(last)
                    alive.add(back[last][0])
                meet = alive.pop()
                if meet > done:
                    yield from path(meet)
                    for old in [e for e in back if e <= meet]:
                        del back[old]
                    done = meet
            base, single = best.pop(at), False
            for end in range(at + 1, min(n, at + self.longest) + 1):
                piece = text[at:end]
                if piece not in heads:
                    break
                found = scores.get(piece)
                if found is not None:
                    single |= end == at + 1
                    total = base + found[0]
                    if end not in best or total > best[end]:
                        best[end], back[end] = total, (at, found[1])
            if not single and (at + 1 not in best or base + self.worst > best[at + 1]):
                best[at + 1], back[at + 1] = base + self.worst, (at, self.v.unknown)
        yield from path(n)

    def within(self, text: str) -> list[tuple[int, int, int]]:
        """The same for a short text between two boundaries, which is a window of its own."""
        n, tree, unknown = len(text), self.tree, self.v.unknown
        best, back = [0.0] + [-np.inf] * n, [None] * (n + 1)
        for at in range(n):
            base = best[at]
            if at and back[at] is None:
                continue
            node, end, single = tree, at, False
            while end < n and (node := node.get(text[end])) is not None:
                end += 1
                found = node.get("")
                if found is not None:
                    if end == at + 1:
                        single = True
                    total = base + found[0]
                    if total > best[end]:
                        best[end], back[end] = total, (at, end, found[1])
            if not single and base + self.worst > best[at + 1]:
                best[at + 1], back[at + 1] = base + self.worst, (at, at + 1, unknown)
        ids, to = [], n
        while to:
            ids.append(back[to])
            to = back[to][0]
        return ids[::-1]

    def ids_of(self, text: str) -> bytes:
        out, unknown_end = array("i"), -1
        for start, end, id_ in self.within(text) if len(text) <= LONG_WORD else self.stream(text):
            if id_ != self.v.unknown:
                out.append(id_)
            elif self.v.bytes_:
                out.extend([self.v.bytes_[b] for b in text[start:end].encode()])
            else:
                if unknown_end != start:
                    out.append(id_)
                unknown_end = end
        return out.tobytes()

    def word(self, word: str) -> bytes:
        if len(word) > LONG_WORD:
            return self.ids_of(word)
        if len(self.known) >= REMEMBER:
            self.older, self.known = self.known, {}
        ids = self.known[word] = self.older.get(word) or self.ids_of(word)
        return ids

    def encode(self, text: str) -> bytes:
        """32-bit ids of a text, one after the other."""
        if not text:
            return b""
        text = ((SPACE if self.v.prefix else "") + text).replace(" ", SPACE)
        if not self.by_words:
            return self.ids_of(text)
        word, lines = self.word, []
        for line in text.split("\n"):
            known = self.known
            if SPACE * 2 in line:
                parts = re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", line)
            else:
                first, *parts = line.split(SPACE)
                parts = [first] * bool(first) + [SPACE + p for p in parts]
            lines.append(b"".join([known.get(p) or word(p) for p in parts]))
        return self.line_end.join(lines)

    def decode(self, ids) -> bytes:
        raw = b"".join(map(self.v.surfaces.__getitem__, ids))
        return raw[1:] if self.v.prefix and raw[:1] == b" " else raw


def _broadcast(docs: DataFrame, vocabulary: Vocabulary):
    return docs.sparkSession.sparkContext.broadcast(tuple(vocabulary))


def encode(docs: DataFrame, vocabulary: Vocabulary, id_column: str = "doc_id") -> DataFrame:
    """(id_column, ids, exact) of every row; ``exact``: decoding returns the text (its U+2581 as spaces)."""
    shared = _broadcast(docs, vocabulary)

    def run(batches):
        encoder = Encoder(Vocabulary(*shared.value))
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids, exact = [], []
                for text in part.column(1).to_pylist():
                    if text is None:
                        ids.append(None)
                        exact.append(None)
                        continue
                    ids.append(encoder.encode(text))
                    exact.append(encoder.decode(np.frombuffer(ids[-1], np.int32).tolist()) == text.replace(SPACE, " ").encode())
                offsets = np.concatenate([[0], np.cumsum([len(x or b"") // 4 for x in ids])]).astype(np.int32)
                flat = pa.array(np.frombuffer(b"".join([x or b"" for x in ids]), np.int32))
                lists = pa.ListArray.from_arrays(pa.array(offsets), flat, mask=pa.array([x is None for x in ids]))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(exact, pa.bool_())], [id_column, "ids", "exact"])

    kind = docs.schema[id_column].dataType.simpleString()
    return map_arrow(docs.select(id_column, "text"), run, f"{id_column} {kind}, ids array<int>, exact boolean")


def decode(encoded: DataFrame, vocabulary: Vocabulary, id_column: str = "doc_id") -> DataFrame:
    """(id_column, text) from rows with ``ids``; bytes that are no UTF-8 become U+FFFD, ids out of range an error."""
    shared = _broadcast(encoded, vocabulary)

    def run(batches):
        decoder = Encoder(Vocabulary(*shared.value))
        for batch in batches:
            texts = [None if x is None else decoder.decode(x).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_column, "text"])

    kind = encoded.schema[id_column].dataType.simpleString()
    return map_arrow(encoded.select(id_column, "ids"), run, f"{id_column} {kind}, text string")
