"""A learned quality score: kernel ridge regression on statistics of a text.

A text becomes some twenty numbers (lengths, shares of kinds of characters,
repetition).  Standardised, they go through random Fourier features, cosines
along random directions, whose inner products approximate a Gaussian kernel.
Every task adds up its part of the normal equations; the sums are solved once,
and an isotonic fit on labelled rows kept apart turns ridge scores into
probabilities.

Fitting takes at most about ``max_labelled`` labelled rows, chosen by a hash of
their ids, which bounds what is summed and what the driver solves; statistics
and scores cover every row.

Defined cases: a null or empty text has statistics of zero and is scored like
any other; of several labels of one document the highest counts; null labels
and labels of unknown documents are left out; without labels of both kinds
every score is their share, or one half without any.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .scratch import freeze, map_arrow

#: What ``statistics`` tells of a text, in order.
NAMES = ("log_chars", "log_words", "log_lines", "word_length", "word_length_spread", "upper", "digits", "other_ascii", "symbols", "exclaims", "stops",
         "beyond_ascii", "spaces", "distinct_words", "repeated_neighbours", "repeated_windows", "words_a_line", "short_words")
_KINDS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "other_ascii": b"\"'()+,-/:;=?@[\\]^_`{}~", "symbols": b"#*$%&|<>", "exclaims": b"!",
          "stops": b".", "lines": b"\n"}


def _kind_table() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for k, chars in enumerate(_KINDS.values(), 1):
        table[list(chars)] = k
    table[128:] = len(_KINDS) + 1
    return table


_TABLE = _kind_table()


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``NAMES`` for each text, in UTF-8 bytes."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    starts, ends, first = A.word_spans(data, offsets)
    words = np.diff(first)
    text_of = np.repeat(np.arange(n), sizes)
    kinds = np.bincount(text_of * 16 + _TABLE[data], minlength=n * 16).reshape(n, 16)
    kind = {k: kinds[:, i] for i, k in enumerate(_KINDS, 1)} | {"beyond_ascii": kinds[:, len(_KINDS) + 1]}
    owner, lengths = np.repeat(np.arange(n), words), (ends - starts).astype(float)
    per = lambda values: np.bincount(owner, values, minlength=n)
    some = np.maximum(words, 1)
    mean = per(lengths) / some
    hashes = A.span_hashes(A.FOLD[data], starts, ends)
    windows = A.window_hashes(hashes, 3)
    same = np.zeros(len(hashes))
    same[1:] = hashes[1:] == hashes[:-1]
    same[first[:-1][first[:-1] < len(hashes)]] = 0
    distinct, fresh = np.zeros(n), np.zeros(n)
    for i, (a, b) in enumerate(zip(first[:-1], first[1:])):
        distinct[i] = len(np.unique(hashes[a:b]))
        fresh[i] = len(np.unique(windows[a:b - 2])) if b - a > 2 else max(b - a - 2, 0)
    chars, letters = np.maximum(sizes, 1), np.maximum(sizes - np.bincount(text_of, A.SPACE[data], minlength=n), 1)
    lines = kind["lines"] + 1
    return np.stack([
        np.log1p(sizes), np.log1p(words), np.log1p(lines), mean, np.sqrt(np.maximum(per(lengths**2) / some - mean**2, 0)), kind["upper"] / letters,
        kind["digits"] / letters, kind["other_ascii"] / letters, kind["symbols"] / some, kind["exclaims"] / some, kind["stops"] / some,
        kind["beyond_ascii"] / chars, 1 - letters / chars, distinct / some, per(same) / some, 1 - fresh / np.maximum(words - 2, 1), words / lines,
        per((lengths <= 2).astype(float)) / some], axis=1)


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of every text."""

    def run(batches):
        for batch in batches:
            for at, end, data, offsets in A.chunks(batch.column(1)):
                x = statistics(data, offsets)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), len(NAMES)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), lists], ["doc_id", "x"])

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<double>")


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(NAMES))


def rising_fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression: (places, values) of its blocks, by pooling neighbours that fall."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum of y, rows, sum of x
    for a, b in zip(x[order], y[order]):
        blocks.append([float(b), 1.0, float(a)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    table = np.array(blocks)
    return table[:, 2] / table[:, 1], table[:, 0] / table[:, 1]


class Model:
    """Standardising, random features, ridge weights and calibration."""

    def __init__(self, mean, spread, features: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, spread
        self.directions = rng.normal(size=(len(mean), features)) / (width * np.sqrt(len(mean)))
        self.phases = rng.uniform(0, 2 * np.pi, features)
        self.weights = np.zeros(features + 1)
        self.calibration = None

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -20, 20)
        return np.hstack([np.cos(z @ self.directions + self.phases) * np.sqrt(2 / len(self.phases)), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability; within a flat part of the calibration the ridge score still orders, by a thousandth."""
        raw = self.raw(x)
        return np.clip(0.999 * np.interp(raw, *self.calibration) + 0.001 * np.clip(raw, 0, 1), 0, 1)


def fit(rows: DataFrame, features: int, width: float, ridge: float, seed: int) -> Model | None:
    """``rows``: doc_id, x and y (0 or 1).  One row in five, by a hash of its id, calibrates."""
    rows = rows.withColumn("_calibrates", F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(5)) == 0)
    moments = rows.agg(*[f(F.get("x", i)).alias(f"{n}{i}") for i in range(len(NAMES)) for n, f in (("m", F.avg), ("s", F.stddev_pop))],
                       F.min("y").alias("low"), F.max("y").alias("high")).first()
    if moments["low"] is None or moments["low"] == moments["high"]:
        return None
    mean = np.array([moments[f"m{i}"] for i in range(len(NAMES))])
    spread = np.maximum([moments[f"s{i}"] for i in range(len(NAMES))], 1e-6)
    model = Model(mean, spread, features, width, seed)

    def sums(batches):
        total = np.zeros((features + 1, features + 2))
        for batch in batches:
            if batch.num_rows:
                z = model.features(matrix(batch.column("x")))
                total += z.T @ np.column_stack([z, batch.column("y").to_numpy()])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    parts = map_arrow(rows.where("not _calibrates").select("x", F.col("y").cast("double")).coalesce(64), sums, "part binary").collect()  # 64 at most
    total = sum(np.frombuffer(r["part"]).reshape(features + 1, features + 2) for r in parts)
    model.weights = np.linalg.solve(total[:, :-1] + ridge * np.eye(features + 1), total[:, -1])
    held = rows.where("_calibrates").select("x", F.col("y").cast("double")).toArrow()  # a bounded sample's fifth
    if held.num_rows:
        held = held.combine_chunks()
        x = matrix(held.column("x").combine_chunks())
        model.calibration = rising_fit(model.raw(x), held.column("y").to_numpy())
    else:
        model.calibration = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    return model


def scored(docs: DataFrame, labels: DataFrame, learn_from, max_labelled: int = 200_000, features: int = 256, width: float = 1.0,
           ridge: float = 1e-2, seed: int = 4) -> DataFrame:
    """(doc_id, score) for every row; learns from ``labels`` (doc_id, y) of documents for which ``learn_from(doc_id)`` holds."""
    known = freeze(described(docs), "statistics")
    best = labels.where("y is not null and doc_id is not null").where(learn_from(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    labelled = known.dropDuplicates(["doc_id"]).join(best, "doc_id")
    n = best.count()
    if n > max_labelled:
        labelled = labelled.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000)) < int(1_000_000 * max_labelled / n))
    labelled = freeze(labelled, "labelled")
    model = fit(labelled, features, width, ridge, seed)
    if model is None:
        share = labelled.agg(F.avg("y")).first()[0]
        return known.select("doc_id", F.lit(0.5 if share is None else float(share)).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(matrix(batch.column(1))))], ["doc_id", "score"])

    return map_arrow(known, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
