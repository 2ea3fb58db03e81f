"""Language identification with interpolated Kneser-Ney character models.

A text is read as its letters in lower case; everything else is one space
between them, and three spaces stand before the first.  Runs of four such
characters are counted over all training texts, by language, on Spark.  From
the counts come the models: the discounted count of a run, and what the
discount frees goes to the run without its first character, whose weight is
the number of different characters seen before it.  A run is a 64-bit number;
mixed, which keeps numbers apart, it is the key of a sorted array, one for
each length, with a row of log probabilities, one for each language.  Scoring
looks runs up by binary search and falls back to shorter ones where no
language has seen a run.

The language with the lowest cross-entropy per character wins, ties to the
lesser code.  Held back from the training texts are some that calibrate: the
temperature at which the models' odds best predict the right language, which
gives the score, and each language's highest usual cross-entropy, beyond which
a text is marked ``rejected``.

Size: every run counts, whatever their number.  Behind a size check (different
runs times languages, ``broadcast_cells``) the models are fitted by the driver
and broadcast.  Beyond it the same models are tables: Spark fits them by
grouping, texts are put into blocks, the different runs of a block are joined
to the tables, and each block is scored with the rows that came back for it.

Defined cases: texts that are null or have no letter are ``und`` with score 0;
so are all texts if nothing was learned.  Letters beyond U+FFFE count as one.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .scratch import freeze, map_arrow

ORDER = 4
UNDETERMINED = "und"
TEMPERATURES = (1, 2, 4, 8, 16, 32, 64)
#: Bytes of text that are scored together where the models are tables.
BLOCK = 16 << 20
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point its letter in lower case, or a space."""
    if not _letters:
        table = np.full(0x110000, 32, np.uint16)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                table[c] = min(ord(low) if len(low) == 1 else c, 0xFFFF)
        _letters.append(table)
    return _letters[0]


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(runs, first): the run of four characters that ends in each character of the texts, and where each text's begin."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]  # in characters
    chars = letters()[points]
    before = np.empty_like(chars)
    before[1:] = chars[:-1]
    before[at[:-1][at[:-1] < len(chars)]] = 32
    stays = (chars != 32) | (before != 32)
    first = np.concatenate([[0], np.cumsum(stays)])[at]
    pad = ORDER - 1
    line = np.full(first[-1] + pad * (len(offsets) - 1), 32, np.uint64)
    places = np.arange(first[-1]) + pad * np.repeat(np.arange(1, len(offsets)), np.diff(first))
    line[places] = chars[stays]
    out = np.zeros(len(places), np.uint64)
    for back in range(ORDER):
        out |= line[places - back] << A.U(16 * back)
    return out, first


def counted(texts: DataFrame) -> DataFrame:
    """(lang, run, n): how often each run stands in the texts of each language."""

    def run(batches):
        seen: dict[str, list] = {}
        held = 0
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for lang in set(langs):
                own = batch.column(1).take(pa.array(np.flatnonzero(langs == lang)))
                for _, _, data, offsets in A.chunks(own):
                    found = np.unique(runs(data, offsets)[0], return_counts=True)
                    seen.setdefault(lang, []).append(found)
                    held += len(found[0])
            if held > 1 << 21:
                yield from told(seen)
                seen, held = {}, 0
        yield from told(seen)

    def told(seen):
        for lang, parts in seen.items():
            keys, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            n = np.bincount(back, np.concatenate([p[1] for p in parts])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "run", "n"])

    parts = map_arrow(texts.select("lang", "text"), run, "lang string, run long, n long")
    return parts.groupBy("lang", "run").agg(F.sum("n").alias("n"))


class Models(NamedTuple):
    """Sorted hash arrays of runs of 4, 3, 2 and 1 characters, and of the contexts of the longer three."""

    langs: list[str]
    keys: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    backoffs: list[np.ndarray]
    floor: np.ndarray

    @classmethod
    def fit(cls, langs: list[str], lang_of: np.ndarray, run: np.ndarray, n: np.ndarray) -> "Models":
        """``lang_of``, ``run``, ``n``: one row for each run of four that a language has."""
        tables = [(lang_of, run, n.astype(float))]
        for _ in range(ORDER - 1):  # without the first character: how many different ones stand before
            own, grams, _ = tables[-1]
            width = ORDER - len(tables)
            pairs = np.stack([own.astype(np.uint64), grams & A.U((1 << 16 * width) - 1)])
            found, count = np.unique(pairs, axis=1, return_counts=True)
            tables.append((found[0].astype(int), found[1], count.astype(float)))
        keys, logs, contexts, backoffs = [], [], [], []
        lower = None
        chars = len(np.unique(tables[-1][1])) + 1
        floor = np.zeros(len(langs))
        for own, grams, count in reversed(tables):  # single characters first
            context = grams >> A.U(16)
            grams_all, g = np.unique(grams, return_inverse=True)
            context_all, c = np.unique(context, return_inverse=True)
            total, kinds = (np.zeros((len(context_all), len(langs))) for _ in range(2))
            seen = np.zeros((len(grams_all), len(langs)))
            cut = np.array([(lambda ones, twos: ones / (ones + 2 * twos) if ones and twos else 0.5)(
                np.sum(count[own == k] == 1), np.sum(count[own == k] == 2)) for k in range(len(langs))])
            np.add.at(total, (c, own), count)
            np.add.at(kinds, (c, own), 1)
            seen[g, own] = np.maximum(count - cut[own], 0)
            where = np.searchsorted(context_all, grams_all >> A.U(16))
            with np.errstate(divide="ignore", invalid="ignore"):
                free = np.where(total > 0, cut * kinds / total, 1.0)  # what the discount frees; all of it in a context not seen
                own_share = np.where(total[where] > 0, seen / total[where], 0.0)
            if lower is None:
                probabilities = own_share + free[where] / chars
                floor = np.log(free[0] / chars)
            else:
                short = grams_all & A.U((1 << 16 * lower[2]) - 1)
                probabilities = own_share + free[where] * lower[1][np.searchsorted(lower[0], short)]
            lower = (grams_all, probabilities, 1 if lower is None else lower[2] + 1)
            for values, out, keys_ in ((probabilities, logs, keys), (free, backoffs, contexts)):
                raw = A.mix(grams_all if keys_ is keys else context_all)
                order = np.argsort(raw)
                keys_.append(raw[order])
                out.append(np.log(values[order]).astype(np.float32))
        return cls(langs, keys[::-1], logs[::-1], contexts[::-1], backoffs[::-1], floor)

    def score(self, grams: np.ndarray, level: int = 0) -> np.ndarray:
        """Log probability of each run's last character after the others; a column for each language."""
        if level == ORDER:
            return np.tile(self.floor.astype(np.float32), (len(grams), 1))
        at, hit = find(self.keys[level], grams)
        out = self.logs[level][at]
        if not hit.all():
            miss = ~hit
            rest = grams[miss]
            if level < ORDER - 1:
                where, known = find(self.contexts[level], rest >> A.U(16))
                back = np.where(known[:, None], self.backoffs[level][where], np.float32(0))
                out[miss] = back + self.score(rest & A.U((1 << 16 * (ORDER - 1 - level)) - 1), level + 1)
            else:
                out[miss] = self.score(rest, ORDER)
        return out

    def cross_entropies(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cross-entropy per character and language, characters, has a letter) of each text."""
        return cross_entropies(data, offsets, self.score, len(self.langs))


def cross_entropies(data: np.ndarray, offsets: np.ndarray, score, n_langs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``Models.cross_entropies``; ``score`` gives the log probabilities of runs."""
    grams, first = runs(data, offsets)
    sums = np.zeros((len(first), n_langs))
    if len(grams):
        total = np.concatenate([np.zeros((1, n_langs)), np.cumsum(score(grams), axis=0, dtype=np.float64)])
        sums = total[first]
    lengths = np.diff(first)
    lettered = np.concatenate([[0], np.cumsum((grams & A.U(0xFFFF)) != A.U(32))])[first]
    return -(sums[1:] - sums[:-1]) / np.maximum(lengths, 1)[:, None], lengths, np.diff(lettered) > 0


def find(keys: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    wanted = A.mix(grams)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """One fold of the documents, by the checksum of their ids; a null id is in none."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def with_entropies(rows, names: list[str], score, n_langs: int):
    """Batches of the columns ``names`` of ``rows`` (a batch with ``text``), ``entropies`` and ``chars``."""
    for at, end, data, offsets in A.chunks(rows.column("text")):
        entropy, chars, lettered = cross_entropies(data, offsets, score, n_langs)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(chars) + 1, dtype=np.int32) * n_langs), pa.array(entropy.reshape(-1)), mask=pa.array(~lettered))
        yield pa.RecordBatch.from_arrays([*(rows.column(c).slice(at, end - at) for c in names), lists, pa.array(chars.astype(np.int64))],
                                         [*names, "entropies", "chars"])


def columns_of(docs: DataFrame, names: list[str]) -> str:
    return "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in names)


def measured(docs: DataFrame, models) -> DataFrame:
    """``docs`` (without its texts) with ``entropies``, one per language, null without a letter, and ``chars``."""
    names = [c for c in docs.columns if c != "text"]

    def run(batches):
        model = Models(*models.value)
        for batch in batches:
            yield from with_entropies(batch, names, model.score, len(model.langs))

    return map_arrow(docs, run, f"{columns_of(docs, names)}entropies array<double>, chars long")


class Tables(NamedTuple):
    """The same models as tables: for 4, 3, 2 and 1 characters (run, values) of log probabilities and of what contexts free.

    ``values`` has a place for each language, null where that language has not seen the run or context.
    """

    langs: list[str]
    logs: list[DataFrame]
    backoffs: list[DataFrame]
    floor: list[float]

    @classmethod
    def fit(cls, langs: list[str], seen: DataFrame) -> "Tables":
        """``seen``: lang, run, n of all runs of four."""

        def packed(table, key, value):
            return freeze(table.groupBy(F.col(key).alias("run")).agg(
                F.array(*[F.max(F.when(F.col("lang") == x, F.log(value).cast("float"))) for x in langs]).alias("values")), "model")

        counts = [seen]
        for width in range(ORDER - 1, 0, -1):  # without the first character: how many different ones stand before
            counts.append(freeze(counts[-1].groupBy("lang", last(width).alias("run")).agg(F.count(F.lit(1)).alias("n")), "runs"))
        chars = counts[-1].select("run").distinct().count() + 1
        logs, backoffs = [], []
        lower = floor = None
        for width, table in enumerate(reversed(counts), 1):
            ones, twos = (F.sum((F.col("n") == k).cast("long")) for k in (1, 2))
            cuts = table.groupBy("lang").agg(F.when((ones > 0) & (twos > 0), ones / (ones + 2 * twos)).otherwise(0.5).alias("cut"))
            each = table.join(F.broadcast(cuts), "lang").withColumn("context", F.shiftrightunsigned("run", 16))  # one row a language
            free = freeze(each.groupBy("lang", "context").agg(
                F.sum("n").alias("total"), (F.first("cut") * F.count(F.lit(1)) / F.sum("n")).alias("free")), "contexts")
            shares = each.join(free, ["lang", "context"]).withColumn("own", F.greatest(F.col("n") - F.col("cut"), F.lit(0.0)) / F.col("total"))
            if lower is None:
                found = {r["lang"]: r["free"] for r in free.collect()}  # one row a language
                floor = [float(np.log(found[x] / chars)) for x in langs]
                below = F.lit(1.0 / chars)
            else:
                shares = shares.withColumn("short", last(width - 1)).join(
                    lower.select("lang", F.col("run").alias("short"), F.col("p").alias("below")), ["lang", "short"])
                below = F.col("below")
            lower = freeze(shares.select("lang", "run", (F.col("own") + F.col("free") * below).alias("p")), "probabilities")
            logs.append(packed(lower, "run", F.col("p")))
            backoffs.append(packed(free, "context", F.col("free")))
        return cls(langs, logs[::-1], backoffs[::-1], floor)

    def score(self, wanted: DataFrame) -> DataFrame:
        """(run, values): log probabilities of the runs of four in ``wanted``, each given once, for each language."""
        out = wanted.select("run")
        for level, (logs, backoffs) in enumerate(zip(self.logs, self.backoffs)):
            width = ORDER - level
            tables = [(last(width), logs, "_p")] + ([(F.shiftrightunsigned(last(width), 16), backoffs, "_b")] if width > 1 else [])
            for key, table, name in tables:
                out = out.withColumn("_key", key).join(
                    table.select(F.col("run").alias("_key"), F.col("values").alias(f"{name}{width}")), "_key", "left").drop("_key")
        floor = F.array(*[F.lit(x).cast("float") for x in self.floor])

        def value(k):
            v = F.get(floor, k)
            for width in range(1, ORDER + 1):
                back = v if width == 1 else F.coalesce(F.get(f"_b{width}", k), F.lit(0).cast("float")) + v
                v = F.coalesce(F.get(f"_p{width}", k), back)
            return v

        return out.select("run", F.transform(F.sequence(F.lit(0), F.lit(len(self.langs) - 1)), value).alias("values"))

    def measured(self, docs: DataFrame) -> DataFrame:
        """As the function ``measured``."""
        names = [c for c in docs.columns if c != "text"]
        n_langs = len(self.langs)

        def deal(batches):
            part, n, held = TaskContext.get().partitionId(), 0, 0
            for batch in batches:
                for at, end, data, _ in A.chunks(batch.column("text")):
                    yield pa.RecordBatch.from_arrays([*batch.slice(at, end - at).columns, pa.array(np.full(end - at, (part << 32) + n))],
                                                     [*batch.schema.names, "_block"])
                    held += len(data) + 64 * (end - at)
                    if held >= BLOCK:
                        n, held = n + 1, 0

        def asked(batches):
            for batch in batches:
                blocks = batch.column("_block").to_numpy()
                for block in np.unique(blocks):
                    for _, _, data, offsets in A.chunks(batch.column("text").take(pa.array(np.flatnonzero(blocks == block)))):
                        found = np.unique(runs(data, offsets)[0])
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), block)), pa.array(found.view(np.int64))], ["_of", "run"])

        def answer(own, rows):
            keys = rows.column("run").to_numpy().view(np.uint64)
            order = np.argsort(keys)
            keys = keys[order]
            values = np.concatenate([c.flatten().to_numpy() for c in rows.column("values").chunks] or [np.zeros(0, np.float32)]).reshape(-1, n_langs)[order]
            out = [b for batch in own.combine_chunks().to_batches() for b in with_entropies(batch, names, lambda g: values[np.searchsorted(keys, g)], n_langs)]
            return pa.Table.from_batches(out)

        dealt = freeze(map_arrow(docs, deal, f"{columns_of(docs, docs.columns)}_block long"), "blocks")
        pairs = freeze(map_arrow(dealt.select("_block", "text"), asked, "_of long, run long").distinct(), "asked")
        told = pairs.join(freeze(self.score(pairs.select("run").distinct()), "told"), "run")
        return dealt.groupBy("_block").cogroup(told.groupBy("_of")).applyInArrow(answer, f"{columns_of(docs, names)}entropies array<double>, chars long")


def last(width: int) -> Column:
    """The last ``width`` characters of a run of at least so many."""
    return F.col("run") if width == ORDER else F.col("run").bitwiseAND(F.lit((1 << 16 * width) - 1).cast("long"))


def odds(temperature: float) -> Column:
    """Share of each language in the softmax of log probabilities at a temperature."""
    least = F.array_min("entropies")
    weights = F.transform("entropies", lambda e: F.exp((least - e) * F.col("chars") / temperature))
    return F.transform(weights, lambda w: w / F.aggregate(weights, F.lit(0.0), lambda a, x: a + x))


def identify(docs: DataFrame, training: DataFrame, usual: float = 0.999, broadcast_cells: int = 1 << 22) -> DataFrame:
    """(doc_id, lang_pred, score, cross_entropy, rejected) for every row of ``docs``.

    ``training``: text, lang and doc_id; texts without a language or letters teach nothing.  One training text in 16, by a
    hash of its id, calibrates instead of being counted.
    """
    known = training.where("lang is not null and text is not null").withColumn("_hold", F.pmod(F.xxhash64("doc_id"), F.lit(16)) == 0)
    seen = freeze(counted(known.where("not _hold")), "runs")
    langs = sorted(r["lang"] for r in seen.select("lang").distinct().collect())
    if not langs:
        return docs.select("doc_id", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"),
                           F.lit(True).alias("rejected"))
    if seen.select("run").distinct().count() * len(langs) <= broadcast_cells:
        table = seen.toArrow()
        own = np.searchsorted(np.array(langs, object), np.array(table.column("lang").to_pylist(), object))
        order = np.lexsort([table.column("run").to_numpy(), own])  # as rows come in any order
        model = Models.fit(langs, own[order], table.column("run").to_numpy().view(np.uint64)[order], table.column("n").to_numpy()[order])
        shared = docs.sparkSession.sparkContext.broadcast(tuple(model))
        measure = lambda texts: measured(texts, shared)
    else:
        measure = Tables.fit(langs, seen).measured

    lang_list = F.array(*[F.lit(x) for x in langs])
    held = freeze(measure(known.where("_hold").select("lang", "text")).where("entropies is not null"), "calibration").withColumn(
        "_own", F.array_position(lang_list, F.col("lang")).cast("int")).where("_own > 0")
    losses = held.agg(*[F.sum(-F.log(F.get(odds(t), F.col("_own") - 1) + 1e-12)).alias(f"t{t}") for t in TEMPERATURES]).first()
    temperature = min(TEMPERATURES, key=lambda t: losses[f"t{t}"]) if losses["t1"] is not None else 1
    limits = {r["lang"]: r["q"] for r in held.groupBy("lang").agg(
        F.percentile(F.get("entropies", F.col("_own") - 1), F.lit(usual)).alias("q")).collect()}  # one row a language
    limit_list = F.array(*[F.lit(float(limits.get(x, np.inf))) for x in langs])
    scored = measure(docs.select("doc_id", "text")).withColumn("_best", F.array_position("entropies", F.array_min("entropies")).cast("int"))
    und = F.col("entropies").isNull()
    at = lambda a: F.get(a, F.col("_best") - 1)
    return scored.select("doc_id", F.when(und, UNDETERMINED).otherwise(at(lang_list)).alias("lang_pred"),
                         F.when(und, 0.0).otherwise(at(odds(temperature))).alias("score"), at(F.col("entropies")).alias("cross_entropy"),
                         F.when(und, True).otherwise(at(F.col("entropies")) > at(limit_list)).alias("rejected"))

