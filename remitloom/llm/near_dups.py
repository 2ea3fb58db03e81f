"""Near-duplicate documents by MinHash over word shingles.

Sketching fills ``coordinates`` bins in rounds: in round i every shingle falls
into one hashed bin with one hashed value and a bin keeps the least value of
its first round; after as many rounds as there are bins, round i offers all
shingles to bin i - coordinates, so every bin fills.  A set of a few hundred
shingles is through in two or three rounds instead of one pass per bin.

Documents with equal sets are one class from then on.  Bands of the sketch
bring classes into buckets.  In each bucket the class that most other buckets
agree with is the hub; every other class is compared with it on the full sets.
Whatever shares a bucket and is not yet connected is compared as well:
directly in small buckets, in large ones by way of the rarest shingles of each
set, of which two linked sets share at least one (prefix filtering), so no
bucket is cut off and no group makes all its pairs.  Components of the links,
found by contraction, give one id per document.

Sets are sets of 64-bit hashes.  A link of similarity s is missed if no band
agrees, (1 - s^rows)^bands: 4e-7 at 0.85 and 4e-5 at 0.8 with 25 bands of 5.

Defined cases: a null, empty or blank text has the empty set and is linked with
nothing, not even with another one; with fewer words than a shingle the whole
sequence is the one shingle; rows with the same id count as one node and are
all returned; a null id stays alone, with a null component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .components import components
from .scratch import freeze, map_arrow

#: Buckets up to this size are compared directly where parts are unconnected: at most so many pairs per row.
SMALL_BUCKET = 40
#: Candidate ids that are broadcast to the second reading of the texts; above, both sides are shuffled.
BROADCAST_IDS = 2_000_000
#: Counters of how common shingles of large buckets are, and the slices in which they are added up.
CELLS, SLICES = 1 << 20, 16


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes; A-Z in lower case."""
    starts, ends, first = A.word_spans(data, offsets)
    words = A.span_hashes(A.FOLD[data], starts, ends)
    windows = A.window_hashes(words, size)
    sets = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= size:
            sets.append(np.unique(windows[a:b - size + 1]))
        else:
            sets.append(A.window_hashes(words[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return sets


def sketches(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """One row of ``coordinates`` values per set, by rounds of bin placement; an empty set has zeros."""
    sizes = np.array([len(s) for s in sets])
    owner, items = np.repeat(np.arange(len(sets)), sizes), np.concatenate([*sets, np.zeros(0, np.uint64)])
    full = np.full((len(sets), coordinates), ~A.U(0))
    flat, done = full.reshape(-1), np.zeros(len(sets) * coordinates, bool)
    done.reshape(len(sets), -1)[sizes == 0] = True
    for turn in range(2 * coordinates):
        open_ = ~done.reshape(len(sets), -1).all(axis=1)
        if not open_.any():
            break
        if not open_.all():
            rows = open_[owner]
            owner, items = owner[rows], items[rows]
        h = A.mix(items, 1000 + turn)
        bins = (h % A.U(coordinates)).astype(np.int64) if turn < coordinates else np.full(len(h), turn - coordinates)
        slots = owner * coordinates + bins
        free = ~done[slots]
        np.minimum.at(flat, slots[free], h[free] >> A.U(8) | A.U(min(turn, 255) << 56))
        done[slots] = True
    full[sizes == 0] = 0
    return full


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def signatures(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, f1, f2, bands): set size, a 128-bit fingerprint of the set, and its band keys."""

    def run(batches):
        for batch in batches:
            for at, end, data, offsets in A.chunks(batch.column(1)):
                sets = shingle_sets(data, offsets, size)
                sketch = sketches(sets, bands * rows)
                keys = np.zeros((len(sets), bands), np.uint64)
                for r in range(rows):
                    keys = A.mix(keys + sketch[:, r::rows], 77 + r)
                keys = A.mix(keys + np.arange(bands, dtype=np.uint64))
                prints = [[A.mix(s, k).sum(dtype=np.uint64) for s in sets] for k in (11, 12)]
                n = len(sets)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, end - at), pa.array([len(s) for s in sets], pa.int64()), *[_signed(np.array(p, np.uint64)) for p in prints],
                    pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), _signed(keys.reshape(-1)))],
                    ["doc_id", "n_shingles", "f1", "f2", "bands"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>")


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, items): the shingle hashes of every document."""

    def run(batches):
        for batch in batches:
            for at, end, data, offsets in A.chunks(batch.column(1)):
                sets = shingle_sets(data, offsets, size)
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                items = pa.ListArray.from_arrays(pa.array(ends), _signed(np.concatenate([*sets, np.zeros(0, np.uint64)])))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), items], ["doc_id", "items"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, items array<long>")


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach num / den of similarity."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("items").alias("_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("items").alias("_b"))
    common = F.size(F.array_intersect("_a", "_b"))
    return pairs.join(left, "a").join(right, "b").where(
        den * common >= num * (F.size("_a") + F.size("_b") - common)).select("a", "b")


def shingle_weights(sets: DataFrame) -> np.ndarray:
    """How many of the sets hold each shingle, at least: a counter for each of ``CELLS`` hash values, added up slice by slice."""
    width = CELLS // SLICES

    def count(batches):
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            total += np.bincount(cell(batch.column("items").flatten().to_numpy().view(np.uint64)), minlength=CELLS)
        for k in range(SLICES):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([total[k * width:(k + 1) * width].tobytes()], pa.binary())], ["slice", "part"])

    def add(batches):
        sums = {}
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[k] = sums.get(k, 0) + np.frombuffer(part.as_buffer(), np.int64)
        for k, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slice", "part"])

    weights = np.zeros((SLICES, width), np.int64)
    parts = map_arrow(map_arrow(sets.select("items"), count, "slice int, part binary").repartition(SLICES, "slice"), add, "slice int, part binary")
    for row in parts.collect():  # SLICES rows of fixed size
        weights[row["slice"]] = np.frombuffer(row["part"], np.int64)
    return weights.reshape(-1)


def cell(items: np.ndarray) -> np.ndarray:
    return (A.mix(items, 900) % A.U(CELLS)).astype(np.int64)


def rare_shingle_pairs(crowded: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs among unconnected classes of large buckets that share one of their rarest shingles.

    Two sets that reach num / den share one of the first n - ceil(num / den * n) + 1 shingles of each, whatever the common
    order; rarest first makes the lists short.  How rare a shingle is comes from counters that several shingles may share:
    they order all sets alike, which is all that is needed, and never count too little.  Behind the first shared one, at
    places i and j, at most the rest of the shorter list can be shared too, which rules out most pairs.
    ``crowded``: (doc_id, part), part: the component so far.
    """
    own = freeze(sets.join(crowded, "doc_id").select("doc_id", "part", "items"), "crowded")
    shared = own.sparkSession.sparkContext.broadcast(shingle_weights(own))  # 8 * CELLS bytes

    def rarest(batches):
        for batch in batches:
            rows = ([], [], [], [], [])
            for doc, part, items in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                values = items.values.to_numpy()
                weight, n = shared.value[cell(values.view(np.uint64))], len(values)
                order = np.lexsort([values, weight])
                left = n - np.arange(n)  # what a list still holds from each place on
                keep = np.flatnonzero((den * left >= num * n) & (weight[order] > 1))
                for column, x in zip(rows, (np.full(len(keep), doc), np.full(len(keep), part), np.full(len(keep), n), left[keep], values[order][keep])):
                    column.append(x.astype(np.int64))
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in rows], ["doc_id", "part", "n", "left", "item"])

    heads = freeze(map_arrow(own, rarest, "doc_id long, part long, n long, left long, item long"), "heads")
    other = heads.select(F.col("doc_id").alias("b"), F.col("part").alias("_part"), F.col("n").alias("_n"), F.col("left").alias("_left"), "item")
    return heads.withColumnRenamed("doc_id", "a").join(other, "item").where(
        (F.col("a") < F.col("b")) & (F.col("part") != F.col("_part")) & (num * F.greatest("n", "_n") <= den * F.least("n", "_n"))
        & ((num + den) * F.least("left", "_left") >= num * (F.col("n") + F.col("_n")))).select("a", "b").distinct()


def links(docs: DataFrame, classes: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """(a, b): links between classes that connect everything that verified links would."""
    keys = classes.select("doc_id", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    rows = freeze(keys.join(shared, "key"), "buckets")  # only buckets with company
    fame = rows.groupBy("doc_id").agg(F.sum("members").alias("fame"))
    famous = rows.join(fame, "doc_id")
    hubs = famous.groupBy("key").agg(F.max(F.struct("fame", (-F.col("doc_id")).alias("hub"), "n")).alias("h")).select(
        "key", (-F.col("h.hub")).alias("hub"), F.col("h.n").alias("hub_n"))
    rows = freeze(rows.join(hubs, "key"), "hubs")
    fits = num * F.greatest("n", "hub_n") <= den * F.least("n", "hub_n")
    pairs = freeze(rows.where((F.col("doc_id") != F.col("hub")) & fits).select(
        F.least("doc_id", "hub").alias("a"), F.greatest("doc_id", "hub").alias("b")).distinct(), "pairs")
    wanted = freeze(rows.select("doc_id").distinct(), "wanted")
    nodes = wanted.count()
    sets = freeze(full_sets(docs.join(F.broadcast(wanted) if nodes <= BROADCAST_IDS else wanted, "doc_id", "left_semi"), size), "sets")
    if sets.count() > nodes:  # rows that share an id: one set of each text is enough
        sets = freeze(sets.dropDuplicates(["doc_id", "items"]), "sets")
    found = freeze(verified(pairs, sets, num, den), "links")

    parts = components(found).select(F.col("node").alias("doc_id"), F.col("component").alias("_component"))
    placed = freeze(rows.join(parts, "doc_id", "left").select("key", "members", "doc_id", "n", F.coalesce("_component", "doc_id").alias("part")), "placed")
    mixed = placed.groupBy("key").agg(F.min("part").alias("_least"), F.max("part").alias("_most")).where("_least < _most").select("key")
    open_ = freeze(placed.join(mixed, "key"), "open")
    right = open_.where(F.col("members") <= SMALL_BUCKET).select("key", F.col("doc_id").alias("b"), F.col("n").alias("_n"), F.col("part").alias("_part"))
    direct = open_.withColumnRenamed("doc_id", "a").join(right, "key").where(
        (F.col("a") < F.col("b")) & (F.col("part") != F.col("_part")) & (num * F.greatest("n", "_n") <= den * F.least("n", "_n"))).select("a", "b")
    crowded = open_.where(F.col("members") > SMALL_BUCKET).select("doc_id", "part").distinct()
    more = direct.distinct().join(pairs, ["a", "b"], "left_anti")
    if not crowded.isEmpty():
        more = more.union(rare_shingle_pairs(crowded, sets, num, den).join(pairs, ["a", "b"], "left_anti")).distinct()
    return found.union(verified(freeze(more, "more"), sets, num, den))


def near_duplicates(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, bands: int = 25, rows: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row; documents with similarity of num / den or more are linked.

    ``component_id`` is the smallest id reachable over links, ``kept`` marks the document that has it.
    """
    own = docs.select("doc_id", "text")
    signed = freeze(signatures(own, shingle, bands, rows), "signatures")
    filled = signed.where("n_shingles > 0 and doc_id is not null")
    classes = freeze(filled.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands")), "classes")
    found = links(own.where("doc_id is not null"), classes.select("doc_id", "n_shingles", "bands"), shingle, num, den)
    copies = filled.select("doc_id", "f1", "f2", "n_shingles").join(classes.select("f1", "f2", "n_shingles", F.col("doc_id").alias("a")),
                                                                     ["f1", "f2", "n_shingles"]).where("doc_id <> a").select("a", F.col("doc_id").alias("b"))
    ids = components(found.union(copies)).select(F.col("node").alias("_node"), F.col("component").alias("_component"))
    joined = signed.join(ids, F.col("doc_id") == F.col("_node"), "left").select(
        "doc_id", "n_shingles", F.coalesce("_component", "doc_id").alias("component_id"))
    return joined.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents without those that another one stands for; rows are otherwise untouched."""
    gone = freeze(near_duplicates(docs, **options).where("not kept").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, docs["doc_id"] == gone["_gone"], "left_anti")
