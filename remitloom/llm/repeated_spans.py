"""Removing passages that another document already has.

A window of ``size`` words is a repeat if its word sequence also starts in a
document with a smaller id.  Only windows that may repeat are worth moving, and
a count-min sketch tells which: every window is represented by its minimiser
(the least hash of the shorter runs inside it, the same for equal windows),
every task sketches the minimisers of its documents, and the sketches are added
up slice by slice.  A count-min sketch never underestimates, so a window that
occurs in two documents is always seen as repeated; what it lets through for
nothing is settled by the second pass, which groups the remaining windows
by a 96-bit hash of their words, in one move.

The merged sketch is kept as one bit per counter, "two or more", and has a
fixed size (``SLICES * DEPTH * CELLS`` bits, 25 MB), which is what is broadcast.
In a corpus that overfills it more windows reach the exact pass; none is lost.

Defined cases: a null or blank text has no words; a text shorter than a window
is never touched; a null id is neither smaller nor larger than another, so that
document keeps all its words and removes none; rows with the same id are
judged each by its own text and never against each other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .scratch import freeze, map_arrow

SLICES, CELLS, DEPTH = 64, 1 << 20, 3
#: Cells in one row of a task's sketch.
PIECE = 8192
#: Values a task holds before it tells their cells; sorting them takes some 200 bytes for each.
FLUSH = 1 << 19


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours, by doubling; empty if there are fewer."""
    if len(values) < width:
        return values[:0]
    step = 1
    while 2 * step <= width:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    return np.minimum(values[:len(values) - (width - step)], values[width - step:]) if width > step else values


def minimisers(words: np.ndarray, size: int) -> np.ndarray:
    """One value per window of ``size`` words, equal for equal windows: the least hash of the runs of half its length."""
    run = (size + 1) // 2
    return sliding_least(A.window_hashes(words, run), size - run + 1)


def cells(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slice, cell) of each value: the slice once, the cell for each row of the sketch."""
    rows = [(A.mix(values, 500 + r) >> A.U(44)).astype(np.int64) % CELLS + r * CELLS for r in range(DEPTH)]
    return (values % A.U(SLICES)).astype(np.int64), np.stack(rows)


def task_sketches(docs: DataFrame, size: int) -> DataFrame:
    """(slice, cells) pieces of the sketch of every task: a cell stands there once for each document, twice at most."""

    def run(batches):
        seen = []
        for batch in batches:
            for at, end, data, offsets in A.chunks(batch.column(1)):
                starts, ends, first = A.word_spans(data, offsets)
                least = minimisers(A.span_hashes(data, starts, ends), size)
                seen += [np.unique(least[a:b - size + 1]) for a, b in zip(first[:-1], first[1:]) if b - a >= size]
            if sum(map(len, seen)) > FLUSH:
                yield from pieces(np.concatenate(seen))
                seen = []
        if seen:
            yield from pieces(np.concatenate(seen))

    def pieces(values):
        owner, rows = cells(values)
        flat = np.concatenate([owner * (DEPTH * CELLS) + r for r in rows])
        found, counts = np.unique(flat, return_counts=True)
        flat = np.sort(np.concatenate([found, found[counts > 1]]))
        edges = np.searchsorted(flat, np.arange(SLICES + 1) * (DEPTH * CELLS))
        for k in range(SLICES):
            own = (flat[edges[k]:edges[k + 1]] - k * (DEPTH * CELLS)).astype(np.uint32)
            parts = [own[i:i + PIECE].tobytes() for i in range(0, len(own), PIECE)]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(parts), pa.int32()), pa.array(parts, pa.binary())], ["slice", "cells"])

    return map_arrow(docs.select("doc_id", "text"), run, "slice int, cells binary")


def merged_sketch(docs: DataFrame, size: int) -> np.ndarray:
    """The sketch of all documents: one bit per counter, set if its count is two or more."""

    def run(batches):
        counters = {}
        for batch in batches:
            for k, cells_ in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = counters.setdefault(k, np.zeros(DEPTH * CELLS, np.uint8))
                at, n = np.unique(np.frombuffer(cells_.as_buffer(), np.uint32), return_counts=True)
                own[at] = np.minimum(own[at] + n, 2)
        for k, own in counters.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(own > 1).tobytes()], pa.binary())], ["slice", "bits"])

    n = min(SLICES, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bits = np.zeros((SLICES, DEPTH * CELLS // 8), np.uint8)
    for row in map_arrow(task_sketches(docs, size).repartition(n, "slice"), run, "slice int, bits binary").toLocalIterator():  # SLICES rows
        bits[row["slice"]] = np.frombuffer(row["bits"], np.uint8)
    return bits


def maybe_repeated(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    owner, rows = cells(values)
    found = np.ones(len(values), bool)
    for r in rows:
        found &= (bits[owner, r >> 3] >> (7 - (r & 7)).astype(np.uint8) & 1).astype(bool)
    return found


def kept_words(text: bytes, size: int, windows: np.ndarray | None = None) -> tuple[bytes, int]:
    """(the words outside the windows joined by a space, number of words inside)."""
    words = text.split()
    if windows is None or not len(windows):
        return b" ".join(words), 0
    cover = np.zeros(len(words) + 1, np.int32)
    np.add.at(cover, windows, 1)
    np.add.at(cover, windows + size, -1)
    stays = np.cumsum(cover)[:-1] == 0
    return b" ".join([words[i] for i in np.flatnonzero(stays)]), int(len(words) - stays.sum())


def candidate_windows(docs: DataFrame, size: int, sketch) -> DataFrame:
    """One row per document: word count, and either the digest of its words or its text with the windows that may repeat.

    Windows come as three arrays: two hashes and a place (a tag of the text, and the number of the first word).
    """

    def run(batches):
        bits = sketch.value
        for batch in batches:
            for at, end, data, offsets in A.chunks(batch.column(1)):
                starts, ends, first = A.word_spans(data, offsets)
                words = A.span_hashes(data, starts, ends)
                least, h1, h2 = minimisers(words, size), A.window_hashes(words, size), A.window_hashes(A.mix(words, 5), size, 5)
                maybe = np.zeros(0, bool)
                if len(least):
                    values, back = np.unique(least, return_inverse=True)
                    maybe = maybe_repeated(bits, values)[back]
                counts, digests, texts, tags, parts = [], [], [], [], []
                ids = batch.column(0).slice(at, end - at)
                for i, doc_id in enumerate(ids.to_pylist()):
                    a, b = int(first[i]), int(first[i + 1])
                    hits = np.flatnonzero(maybe[a:b - size + 1]) if b - a >= size and doc_id is not None else np.zeros(0, np.int64)
                    raw = data[offsets[i]:offsets[i + 1]].tobytes()
                    counts.append(b - a)
                    tag = int(A.mix(A.window_hashes(words[a:b], b - a) >> A.U(33))[0] >> A.U(33)) if len(hits) else 0
                    tags.append(tag)
                    digests.append(None if len(hits) else hashlib.sha256(kept_words(raw, size)[0]).hexdigest())
                    texts.append(raw if len(hits) else None)
                    parts.append((h1[a + hits], h2[a + hits] >> A.U(32), hits + (tag << 32)))
                ends_ = pa.array(np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])]).astype(np.int32))
                h1_, h2_, place = (np.concatenate([p[k] for p in parts]) for k in range(3))
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(counts, pa.int64()), pa.array(tags, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.binary()),
                    pa.ListArray.from_arrays(ends_, pa.array(h1_.view(np.int64))), pa.ListArray.from_arrays(ends_, pa.array(h2_.astype(np.uint32).view(np.int32))),
                    pa.ListArray.from_arrays(ends_, pa.array(place.astype(np.int64)))], ["doc_id", "n_words", "tag", "digest", "raw", "h1", "h2", "place"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run,
        "doc_id long, n_words long, tag long, digest string, raw binary, h1 array<long>, h2 array<int>, place array<long>")


def repeated_places(windows: DataFrame) -> DataFrame:
    """(doc_id, place) of the windows that also start in a document with a smaller id.

    The windows are moved once: range-partitioned by hash and document, so one that very many documents have spreads over
    many partitions, and sorted within.  The first row of a hash then has its least document.  Only of a partition's
    first hash the least one may lie in partitions before; those rows wait for it, and every partition tells the least
    document of its first and last hash.  These two rows a partition are all that the driver sees; it answers with one
    least document for each partition.
    """
    n = int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = windows.repartitionByRange(n, "h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id")
    names = ["kind", "h1", "h2", "doc_id", "place"]

    def run(batches):
        first = key = least = first_least = None
        part = TaskContext.get().partitionId()

        def rows(kind, h1, h2, doc, place):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), kind, np.int32)), *map(pa.array, (h1, h2, doc, place))], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2, doc, place = (batch.column(k).to_numpy() for k in names[1:])
            new = np.ones(len(h1), bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            new[0] = key != (h1[0], h2[0])
            starts = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            leasts = np.concatenate([doc[starts], [least if least is not None else 0]])[group]  # group -1: the one begun before
            first = first or (h1[0], h2[0])
            waits = (h1 == first[0]) & (h2 == first[1])
            hits = ~waits & (doc > leasts)
            yield rows(0, np.zeros(hits.sum(), np.int64), np.zeros(hits.sum(), np.int32), doc[hits], place[hits])
            if waits.any():
                first_least = doc[0] if first_least is None else first_least
                yield rows(1, np.zeros(waits.sum(), np.int64), np.full(waits.sum(), part, np.int32), doc[waits], place[waits])
            key, least = (h1[-1], h2[-1]), leasts[-1]
        if key is not None:
            told_ = ((*first, first_least), (*key, least))
            yield rows(2, *(np.array([t[k] for t in told_]) for k in range(3)), np.full(2, part, np.int64))

    told = freeze(map_arrow(ordered, run, "kind int, h1 long, h2 int, doc_id long, place long"), "told")
    edges = told.where("kind = 2").collect()  # two rows a partition: its first hash, its last
    least_of = {}
    for r in edges:
        least_of[r.h1, r.h2] = min(r.doc_id, least_of.get((r.h1, r.h2), r.doc_id))
    leasts = [None] * (1 + max([r.place for r in edges], default=0))
    for r in sorted(edges, key=lambda r: (r.place, r.h1, r.h2), reverse=True):
        leasts[r.place] = least_of[r.h1, r.h2]  # of its first hash, which sorts before its last
    known = F.get(F.array(*[F.lit(x).cast("long") for x in leasts]), F.col("h2"))
    return told.where((F.col("kind") == 0) | ((F.col("kind") == 1) & (F.col("doc_id") > known))).select("doc_id", "place")


def without_repeats(docs: DataFrame, size: int = 50) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) for every row; ``kept`` is null where all words stay.

    Words inside repeated windows go; the rest, joined by one space, is ``kept``.
    """
    spark = docs.sparkSession
    sketch = spark.sparkContext.broadcast(merged_sketch(docs, size))
    candidates = freeze(candidate_windows(docs, size, sketch), "windows")
    first = F.col("place").bitwiseAND(0xFFFFFFFF)
    if candidates.where("digest is null").groupBy("doc_id").count().where("count > 1").isEmpty():  # no id has two texts: places need no tag
        candidates = candidates.withColumn("tag", F.lit(0).cast("long")).withColumn("place", F.transform("place", lambda p: p.bitwiseAND(0xFFFFFFFF)))
    windows = candidates.where("digest is null").select("doc_id", F.explode(F.arrays_zip("h1", "h2", "place")).alias("w")).select(
        "doc_id", "w.h1", "w.h2", "w.place")
    gone = repeated_places(windows).groupBy(F.col("doc_id").alias("_doc"), F.shiftright("place", 32).alias("_tag")).agg(
        F.collect_list(first.cast("int")).alias("gone"))
    touched = candidates.where("digest is null").select("doc_id", "n_words", "tag", "raw").join(
        gone, (F.col("doc_id") == F.col("_doc")) & (F.col("tag") == F.col("_tag")), "left").select("doc_id", "n_words", "raw", "gone")

    def cut(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = []
            for raw, windows_ in zip(batch.column("raw"), batch.column("gone")):
                kept, removed = kept_words(raw.as_buffer().to_pybytes(), size, windows_.values.to_numpy() if windows_.is_valid else None)
                rows.append((removed, hashlib.sha256(kept).hexdigest(), kept.decode() if removed else None))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), *map(pa.array, zip(*rows), (pa.int64(), pa.string(), pa.string()))],
                                             ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    cut_ = map_arrow(touched, cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    whole = candidates.where("digest is not null").select(
        "doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("digest").alias("kept_sha256"), F.lit(None).cast("string").alias("kept"))
    return cut_.union(whole)
