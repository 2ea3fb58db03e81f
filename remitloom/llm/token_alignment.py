"""Which tokens of two tokenizers stand for the same bytes, and how often each pair of ids does.

Tokenizer A is a byte-level BPE of ``tokenizers``, B a model of
``sentencepiece``; both cut the same bytes, a space and the text.  Places where
a token of A and one of B end cut the bytes into groups; an A and a B token are
linked if they share one.

Cuts: A's character offsets and the spans of B's encoding are coarse cuts.
They are the truth except where a character is spread over several tokens: A
then gives all of them the whole character, B's byte pieces an empty span or
all of it.  From the last sure cut on those tokens' ends are counted in the
bytes they decode to.  Decoded bytes are also checked as a whole: a text whose
bytes do not come back has no tokens here.

Words are not encoded again wherever they occur.  The place before a space that
follows another character and precedes no white space is a boundary for both
vocabularies (checked when they are read: A splits there before it merges, no
piece of B has the space behind another character).  The stretches between,
mostly words, are encoded once a block of texts, many in one call.  With other
vocabularies a text is one stretch.

Counting: how many documents hold a pair linked is wanted for every link, and
links are many times the tokens.  So they never leave their block of
``block_bytes`` of text as rows: a block holds its stretches with their pairs,
its texts as lists of stretches, and its distinct pairs with the number of
texts that hold each.  Spark sums the latter over blocks and finds the highest
count of each A id; each block gets back the counts of its own pairs and works
out its texts' sums.  What is shuffled are distinct pairs a block and the
packed blocks; nothing is broadcast but the two vocabularies.

Defined cases: a null or empty text has no tokens (zeros, '' as groups); rows
that share an id are documents of their own; text of any length is encoded
whole, a text longer than a block is a block of its own.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pieces import SPACE, Vocabulary
from .scratch import freeze, map_arrow

#: Text of one block, and stretches encoded in one call.
BLOCK, CALL = 32 << 20, 64
# A space before another white space joins what is around it; so does one at either end of a text.
_WIDE = re.compile(r"\x20\s")
_CUT = re.compile(r"(?<=[^\x20])(?=\x20\S)")
#: An id has less than 2**ID_BITS; a pair is one number.
ID_BITS = 20
COLUMNS = ("n_a", "n_b", "n_groups", "n_links")


def byte_alphabet() -> dict[str, int]:
    """The characters byte-level vocabularies write bytes with: printable ones stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class Tokenizers(NamedTuple):
    """Both tokenizers as texts and bytes, to be sent to tasks; some MB, whatever the documents."""

    a: str
    b: bytes
    surfaces_a: list[bytes]
    surfaces_b: list[bytes]
    byte_pieces: frozenset[int]
    by_words: bool

    @classmethod
    def load(cls, path_a: str, path_b: str) -> "Tokenizers":
        with open(path_a, encoding="utf-8") as f:
            a = f.read()
        with open(path_b, "rb") as f:
            b = f.read()
        spec, alphabet = json.loads(a), byte_alphabet()
        if spec["model"]["type"] != "BPE" or (spec.get("decoder") or {}).get("type") != "ByteLevel":
            raise ValueError(f"{path_a}: not a byte-level vocabulary")
        surfaces = {i: bytes(alphabet[c] for c in piece) for piece, i in spec["model"]["vocab"].items()}
        for added in spec.get("added_tokens", []):
            surfaces[added["id"]] = added["content"].encode()
        split = spec.get("pre_tokenizer") or {}
        apart_a = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not spec.get("normalizer")
        model = Vocabulary.load(path_b)
        if not model.prefix:
            raise ValueError(f"{path_b}: adds no space before a text")
        apart_b = not any(SPACE in p.lstrip(SPACE) for p in model.scores)
        if max(len(model.surfaces), max(surfaces) + 1) > 1 << ID_BITS:
            raise ValueError("vocabularies of more ids than a pair has room for")
        return cls(a, b, [surfaces.get(i, b"") for i in range(max(surfaces) + 1)], model.surfaces, frozenset(model.bytes_), bool(apart_a and apart_b))


def byte_ends(char_ends: np.ndarray, sure: np.ndarray, lengths: np.ndarray, bytes_before: np.ndarray) -> np.ndarray:
    """Where tokens end in bytes: at their character offset where that is sure, else counted on from the last sure end."""
    counted = np.cumsum(lengths)
    last = np.maximum.accumulate(np.where(sure, np.arange(len(sure)), -1))
    coarse = np.where(sure, bytes_before[char_ends], 0)
    known = last >= 0
    return np.where(known, coarse[last] + counted - np.where(known, counted[last], 0), counted)


class Stretches:
    """Tokens, groups and linked pairs of the stretches of one block, each encoded once."""

    def __init__(self, tokenizers: Tokenizers):
        import sentencepiece
        from tokenizers import Tokenizer

        self.t = tokenizers
        self.a = Tokenizer.from_str(tokenizers.a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=tokenizers.b)
        self.lengths_a, self.lengths_b = (np.array([len(x) for x in s]) for s in (tokenizers.surfaces_a, tokenizers.surfaces_b))
        self.is_byte = np.zeros(len(self.lengths_b), bool)
        self.is_byte[list(tokenizers.byte_pieces)] = True
        # ids as written in a group: followed by a comma inside a side, a bar after A's last, a semicolon after B's last
        self.written = [f"{i}{end}".encode() for surfaces, ends in ((tokenizers.surfaces_a, ",|"), (tokenizers.surfaces_b, ",;")) for end in ends for i in range(len(surfaces))]
        self.written_size = np.array(list(map(len, self.written)))
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[bytes] = []
        self.broken: set[int] = set()  # stretches whose bytes do not come back
        self.counts: list[np.ndarray] = []  # rows of n_a, n_b, n_groups, n_links
        self.pairs: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []  # pairs of each stretch

    def cut(self, text: str) -> list[str]:
        """The stretches of a space and a text."""
        if not self.t.by_words:
            return [" " + text]
        if text[0].isspace() or text[-1] == " " or _WIDE.search(text):
            return _CUT.split(" " + text)
        return [" " + s for s in text.split(" ")]

    def numbers(self, texts: list[list[str]]) -> list[list[int]]:
        """The stretches of texts as numbers; new ones are encoded."""
        new, alone = [], []
        for stretch in sorted(set().union(*texts).difference(self.number)):
            joins = self.t.by_words and stretch[-1] != " " and not stretch[1].isspace()
            (new if joins else alone).append(stretch)
        self.encode([new[at:at + CALL] for at in range(0, len(new), CALL)] + [[stretch] for stretch in alone])
        return [list(map(self.number.__getitem__, text)) for text in texts]

    def encode(self, calls: list[list[str]]) -> None:
        """Encode stretches, those of a call together; one by one if the bytes of a call do not come back."""
        surfaces_a, surfaces_b = self.t.surfaces_a.__getitem__, self.t.surfaces_b.__getitem__
        texts, known, ids_a, ids_b, spans_a, spans_b, sizes = [], [], [], [], [], [], []
        while calls:
            call = calls.pop()
            text = "".join(call)
            a, b = self.a.encode(text, add_special_tokens=False), self.b.encode(text[1:], return_type="offset_mapping")
            own_a, own_b, raw = a.ids, b["ids"], text.encode()
            if b"".join(map(surfaces_a, own_a)) == raw and b"".join(map(surfaces_b, own_b)) == raw:
                texts.append(text)
                known += call
                ids_a += own_a
                ids_b += own_b
                spans_a += a.offsets
                spans_b += b["offsets"]
                sizes.append((len(own_a), len(own_b), len(text)))
            elif len(call) > 1:
                calls += [[stretch] for stretch in call]
            else:
                self.broken.add(len(self.number))
                none = np.zeros(0, np.int64)
                self.add(call, [b""], np.zeros((1, 4), np.int64), none, none, np.zeros(1, np.int64))
        if not known:
            return
        text = "".join(texts)
        raw = text.encode()
        if len(raw) == len(text):
            before = np.arange(len(text) + 1)
            stretch_ends = np.cumsum(np.fromiter(map(len, known), np.int64, len(known)))
        else:
            before = np.append(np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80), len(raw))
            stretch_ends = before[np.cumsum(np.fromiter(map(len, known), np.int64, len(known)))]
        by_call = np.array(sizes)
        base = np.cumsum(by_call[:, 2]) - by_call[:, 2]  # where the characters of each call begin
        na, nb = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        spans_a = np.fromiter(chain.from_iterable(spans_a), np.int64, 2 * len(na)).reshape(-1, 2) + np.repeat(base, by_call[:, 0])[:, None]
        spans_b = np.fromiter(chain.from_iterable(spans_b), np.int64, 2 * len(nb)).reshape(-1, 2) + np.repeat(base, by_call[:, 1])[:, None]
        sure_a = np.append(spans_a[1:, 0] >= spans_a[:-1, 1], True)
        ends_a = byte_ends(spans_a[:, 1], sure_a, self.lengths_a[na], before)
        # B sees the text of a call without the space it adds
        ends_b = byte_ends(spans_b[:, 1] + 1, ~self.is_byte[nb], self.lengths_b[nb], before)
        both = np.zeros(len(raw) + 1, np.int8)
        both[ends_a] = 1
        both[ends_b] |= 2
        cuts = np.flatnonzero(both == 3)
        size_a, size_b = (np.bincount(np.searchsorted(cuts, ends, "left"), minlength=len(cuts)) for ends in (ends_a, ends_b))
        to_a, to_b = np.cumsum(size_a), np.cumsum(size_b)
        own = np.searchsorted(stretch_ends, cuts, "left")  # the stretch of each group
        links = size_a * size_b
        counts = np.stack([np.bincount(own, w, len(known)) for w in (size_a, size_b, None, links)], 1).astype(np.int64)
        # every A token of a group beside every B token of it
        group = np.repeat(np.arange(len(cuts)), links)
        place = np.arange(len(group)) - (np.cumsum(links) - links)[group]
        pair = na[(to_a - size_a)[group] + place // size_b[group]] << ID_BITS | nb[(to_b - size_b)[group] + place % size_b[group]]
        pair |= own[group] << 2 * ID_BITS
        pair.sort()
        first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        times, pair = np.diff(np.append(first, len(pair))), pair[first]
        # the ids of both sides group by group, A's first
        side = np.concatenate([np.repeat(np.arange(len(cuts)) * 2, size_a), np.repeat(np.arange(len(cuts)) * 2 + 1, size_b)])
        form = np.concatenate([na, nb + 2 * len(self.lengths_a)])
        form[to_a - 1] += len(self.lengths_a)
        form[len(na) + to_b - 1] += len(self.lengths_b)
        form = form[np.argsort(side, kind="stable")]
        written, ends = b"".join(map(self.written.__getitem__, form.tolist())), np.cumsum(self.written_size[form])
        edges = [0, *ends[np.cumsum(counts[:, 0] + counts[:, 1]) - 1].tolist()]
        self.add(known, [written[i:j] for i, j in zip(edges, edges[1:])], counts, pair & (1 << 2 * ID_BITS) - 1, times,
                 np.bincount(pair >> 2 * ID_BITS, minlength=len(known)))

    def add(self, stretches, groups, counts, pairs, times, sizes) -> None:
        self.number.update(zip(stretches, range(len(self.number), len(self.number) + len(stretches))))
        self.groups += groups
        for store, part in ((self.counts, counts), (self.pairs, pairs), (self.times, times), (self.sizes, sizes)):
            store.append(part)


def gather(starts: np.ndarray, sizes: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Places of all entries of the chosen lists, one list after the other."""
    n = sizes[chosen]
    return np.repeat(starts[chosen] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def pack(*columns: np.ndarray) -> bytes:
    """Arrays of whole numbers, each as narrow as its values allow."""
    narrow = [c.astype(np.min_scalar_type(int(c.max(initial=0)))) for c in columns]
    head = json.dumps([(c.dtype.str, len(c)) for c in narrow]).encode()
    return len(head).to_bytes(4, "little") + head + zlib.compress(b"".join(c.tobytes() for c in narrow), 1)


def unpack(raw: bytes) -> list[np.ndarray]:
    n = int.from_bytes(raw[:4], "little")
    data, at, out = zlib.decompress(raw[4 + n:]), 0, []
    for kind, size in json.loads(raw[4:4 + n]):
        out.append(np.frombuffer(data, kind, size, at).astype(np.int64))
        at += out[-1].size * np.dtype(kind).itemsize
    return out


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of neighbouring stretches of ``values``."""
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


class Block:
    """Texts that share their stretches."""

    def __init__(self, stretches: Stretches):
        self.s = stretches
        stretches.clear()
        self.ids, self.hashes, self.used, self.n_used, self.bytes = [], [], [], [], 0

    def add(self, ids: pa.Array, texts: list[str | None]) -> None:
        self.ids.append(ids)
        for found in self.s.numbers([self.s.cut(t) if t else [] for t in texts]):
            if not self.s.broken.isdisjoint(found):
                found = []
            self.hashes.append(hashlib.sha256(b"".join(map(self.s.groups.__getitem__, found))[:-1]).hexdigest() if found else "")
            self.used.append(np.array(found, np.int32))
        self.bytes += sum(len(t or "") for t in texts)

    def row(self, number: int, names: list[str]) -> pa.RecordBatch:
        """The block as one row: ids and hashes by text, distinct pairs and how many texts hold each, the rest packed."""
        stack = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int64)
        sizes, times = stack(self.s.sizes), stack(self.s.times)
        pairs, place = np.unique(stack(self.s.pairs), return_inverse=True)
        place = place.astype(np.int32)
        starts, counts = np.cumsum(sizes) - sizes, np.concatenate([np.zeros((0, 4), np.int64), *self.s.counts])
        docs, mark = np.zeros(len(pairs), np.int32), np.zeros(len(pairs), np.int32)
        for used in self.used:
            held = place[gather(starts, sizes, used)]
            turn = np.arange(len(held), dtype=np.int32)
            mark[held] = turn  # of equal pairs the last one stays
            docs[held[mark[held] == turn]] += 1
        n_used, used = np.array([len(u) for u in self.used], np.int64), stack(self.used)
        body = pack(n_used, used, sizes, place, times, *(sums(counts[used, c], n_used) for c in range(4)))
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        return pa.RecordBatch.from_arrays([
            pa.array([number], pa.int64()), one(pa.concat_arrays(self.ids)), one(pa.array(self.hashes, pa.string())),
            one(pa.array(pairs, pa.int64())), one(pa.array(docs, pa.int32())), pa.array([body], pa.binary())], names)


def blocks(docs: DataFrame, tokenizers: Tokenizers, id_column: str, block_bytes: int = BLOCK) -> DataFrame:
    """(block, ids, hashes, pairs, docs, body): one row a block."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(tokenizers))
    names = ["block", "ids", "hashes", "pairs", "docs", "body"]

    def run(batches):
        stretches, number = Stretches(Tokenizers(*shared.value)), TaskContext.get().partitionId() << 32
        block = Block(stretches)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, 100)
                texts, size, n = part.column(1).to_pylist(), 0, 0
                while n < len(texts) and (not n or size < block_bytes >> 3):
                    size += len(texts[n] or "")
                    n += 1
                if block.bytes and block.bytes + size > block_bytes:
                    yield block.row(number, names)
                    number, block = number + 1, Block(stretches)
                block.add(part.column(0).slice(0, n), texts[:n])
                at += n
        if block.ids:
            yield block.row(number, names)

    kind = docs.schema[id_column].dataType.simpleString()
    return map_arrow(docs.select(id_column, "text"), run,
                     f"block long, ids array<{kind}>, hashes array<string>, pairs array<long>, docs array<int>, body binary")


def pair_counts(cut: DataFrame) -> DataFrame:
    """(pair, n, best): in how many documents each pair is linked, and whether none of its A id is in more.

    The window holds the pairs of one A id, at most as many as B has ids.
    """
    counts = cut.select(F.explode(F.arrays_zip("pairs", "docs")).alias("p")).where("p.docs > 0").groupBy(
        F.col("p.pairs").alias("pair")).agg(F.sum("p.docs").alias("n"))
    top = F.max("n").over(Window.partitionBy(F.shiftright("pair", ID_BITS)))
    return counts.select("pair", "n", (F.col("n") == top).alias("best"))


def align(docs: DataFrame, tokenizers: Tokenizers, id_column: str = "doc_id", block_bytes: int = BLOCK) -> DataFrame:
    """(id_column, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    ``count_sum`` adds up, over all linked occurrences, in how many documents
    the pair is linked; ``n_best`` counts the occurrences whose pair is linked
    in as many documents as any pair of its A id.
    """
    cut = freeze(blocks(docs, tokenizers, id_column, block_bytes), "alignment")
    entries = cut.select(F.col("block").alias("of"), F.posexplode("pairs").alias("place", "pair"))
    known = entries.join(pair_counts(cut), "pair").select("of", "place", "n", "best")
    names = [id_column, *COLUMNS, "n_best", "count_sum", "groups_sha256"]

    def judge(block: pa.Table, known: pa.Table) -> pa.Table:
        ids, hashes = (block.column(c).combine_chunks() for c in ("ids", "hashes"))
        n_used, used, sizes, place, times, *by_text = unpack(block.column("body")[0].as_py())
        n, best = np.zeros((2, int(place.max(initial=-1)) + 1), np.int64)
        at = known.column("place").to_numpy()
        n[at], best[at] = known.column("n").to_numpy(), known.column("best").to_numpy(zero_copy_only=False)
        n_best, count_sum = (sums(sums(times * of[place], sizes)[used], n_used) for of in (best, n))
        return pa.Table.from_arrays([ids.flatten(), *map(pa.array, by_text), pa.array(n_best), pa.array(count_sum), hashes.flatten()], names)

    kind = docs.schema[id_column].dataType.simpleString()
    numbers = ", ".join(f"{c} long" for c in names[1:-1])
    packed = cut.select("block", "ids", "hashes", "body").groupBy("block")
    return packed.cogroup(known.groupBy("of")).applyInArrow(judge, f"{id_column} {kind}, {numbers}, groups_sha256 string")
