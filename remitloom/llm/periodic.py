"""Periodic runs of words: stretches in which a passage repeats again and again.

A run is a stretch of a text's words with smallest period ``q`` (words ``q``
apart are equal) and a length of at least ``least`` words and ``times`` periods
that no neighbouring word extends.

Seeds: of a run, positions ``i`` and ``i + q`` agree on at least
``max(least, times * q) - q`` words.  Lags are dealt into classes
``2**j <= q < 2**(j + 1)``; the least such overlap from a class on is the length
``k`` of its seeds, the k-grams indexed for it.  With ``times >= 3`` a seed is
no shorter than any period of its class, so inside a run of smallest period
``q`` the next occurrence of a seed lies exactly ``q`` words on (a nearer one
would give the run a smaller period).  Hence neighbouring occurrences are
enough, one pair a position and class, however often a k-gram occurs; only
positions whose k-gram repeats go on to the next, longer class.

Extension: pairs of one lag are taken by position.  A table by lag holds how
far the diagonal has been compared; a pair that lies before that place belongs
to a stretch already extended and is passed over.  The others grow to both
sides by comparing ever larger blocks of words.

Words are compared by 64-bit hashes.  Memory follows the longest text of a
batch (some 100 bytes a word); no text meets another, so nothing is shuffled.

Defined cases: a null, empty or blank text has no words and no runs; rows that
share an id are searched each by its own text; a word is ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .scratch import map_arrow

LEAST, TIMES = 6, 4


def seed_length(low: int, least: int, times: int) -> int:
    """Words that positions a period apart share at least, over all periods from ``low`` on; it never falls as ``low`` grows."""
    return min(max(least, times * q) - q for q in (low, max(low, least // times), max(low, least // times + 1)))


def seeds(words: np.ndarray, first: np.ndarray, least: int, times: int):
    """(lag, position) of neighbouring occurrences of k-grams in one text, for each class of lags."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    ends, longest = first[1:][text], int(np.diff(first).max(initial=0))
    left, low = np.arange(len(words)), 1
    while len(left) and max(least, times * low) <= longest:
        k = seed_length(low, least, times)
        left = left[left + k <= ends[left]]
        grams = A.window_hashes(words, k)[left] ^ A.mix(text[left].astype(np.uint64))
        order = np.argsort(grams, kind="stable")
        at, same = left[order], grams[order][1:] == grams[order][:-1]
        lag = at[1:] - at[:-1]
        near = same & (lag >= low) & (lag < 2 * low) & (text[at[1:]] == text[at[:-1]])
        yield lag[near], at[:-1][near]
        again = np.zeros(len(at), bool)
        again[1:] = same
        again[:-1] |= same
        left, low = np.sort(at[again]), 2 * low


def reach(words: np.ndarray, at: int, lag: int, low: int, high: int) -> tuple[int, int]:
    """The stretch around ``at`` on which words ``lag`` apart agree, inside the text [low, high)."""
    start, end, step = at, at, 16
    while end + lag < high:
        stop = min(end + step, high - lag)
        differ = words[end:stop] != words[end + lag:stop + lag]
        if differ.any():
            end += int(differ.argmax())
            break
        end, step = stop, 2 * step
    step = 16
    while start > low:
        stop = max(start - step, low)
        differ = words[stop:start] != words[stop + lag:start + lag]
        if differ.any():
            start -= int(differ[::-1].argmax())
            break
        start, step = stop, 2 * step
    return start, end


def runs_of(words: np.ndarray, first: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, by text, start and period; ``first`` says where texts begin."""
    found = []
    for lags, positions in seeds(words, first, least, times):
        furthest: dict[int, int] = {}
        order = np.lexsort((positions, lags))
        lags, positions = lags[order], positions[order]
        heads = np.ones(len(lags), bool)  # a seed right behind one of its lag lies on the same stretch
        heads[1:] = (lags[1:] != lags[:-1]) | (positions[1:] != positions[:-1] + 1)
        for lag, at in zip(lags[heads].tolist(), positions[heads].tolist()):
            if at < furthest.get(lag, -1):
                continue
            text = int(np.searchsorted(first, at, "right")) - 1
            start, end = reach(words, at, lag, int(first[text]), int(first[text + 1]))
            furthest[lag] = end
            if end + lag - start >= max(least, times * lag):
                found.append((text, start - int(first[text]), end + lag - start, lag))
    return np.array(sorted(found, key=lambda r: (r[0], r[1], r[3])), np.int64).reshape(-1, 4)


def dropped(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of a text's words a run holds after its first period."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, runs[:, 1] + runs[:, 3], 1)
    np.add.at(edges, runs[:, 1] + runs[:, 2], -1)
    return np.cumsum(edges[:-1]) > 0


def find(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(id_column, n_words, runs, collapsed) of every row.

    ``runs`` are (start, length, period) in words, by start, then period;
    ``collapsed`` is the text without the words that a run holds after its
    first period, joined by one space.
    """
    if times < 3 or least < 2:
        raise ValueError("a run needs at least three periods and two words")
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def search(batches):
        for batch in batches:
            for at, end, data, offsets in A.chunks(batch.column(1)):
                starts, ends, first = A.word_spans(data, offsets)
                runs = runs_of(A.span_hashes(data, starts, ends), first, least, times)
                raw, by_text = data.tobytes(), np.searchsorted(runs[:, 0], np.arange(end - at + 1))
                texts = []
                for i in range(end - at):
                    words, own = raw[offsets[i]:offsets[i + 1]].split(), runs[by_text[i]:by_text[i + 1]]
                    texts.append(b" ".join(compress(words, ~dropped(len(words), own)) if len(own) else words))
                lists = pa.ListArray.from_arrays(pa.array(by_text.astype(np.int32)), pa.StructArray.from_arrays(
                    [pa.array(runs[:, c]) for c in (1, 2, 3)], fields=list(run_type)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, end - at), pa.array(np.diff(first), pa.int64()), lists, pa.array(texts, pa.binary()).cast(pa.string())],
                    [id_column, "n_words", "runs", "collapsed"])

    kind = docs.schema[id_column].dataType.simpleString()
    return map_arrow(docs.select(id_column, text_column), search,
                     f"{id_column} {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def longest_run():
    """The longest of a row's ``runs``; of several the first, then the one with the smallest period; null without runs."""
    ranked = F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period")))
    return F.array_min(ranked)
