"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

A text's words are runs of bytes outside ``[\\x20\\x09-\\x0D]``; those bytes stand
for themselves in UTF-8, so no text is decoded.  A word's hash is a polynomial
over its bytes' random values, read off one running sum, and mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A"):ord("Z") + 1] += 32
_VALUES = np.random.default_rng(1).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = 0x9E3779B97F4A7C15
#: Bytes of text that are worked on at once; one longer text makes a chunk of its own.
CHUNK = 1 << 20


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x + U((seed * 0x632BE59BD9B4E019 + 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Powers:
    """Powers of a base modulo 2**64 and of its inverse, as many as have been asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))


_BYTES, _WINDOWS = Powers(BASE), Powers(0xD1342543DE82EF95)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty texts."""
    column = pa.compute.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of pieces of a column of about CHUNK bytes."""
    if not len(column):
        return
    data, offsets = utf8(column)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        end = min(end, len(column))
        yield at, end, data[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at]
        at = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of all words, and where each text's words begin among them (one more at the end)."""
    inside = ~SPACE[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[1:-1]
    before[edges[edges < len(data)]] = False
    after[edges[edges > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    _BYTES.reach(len(data) + 1)
    values = _VALUES if not seed else mix(_VALUES, seed)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * _BYTES.up[:len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _BYTES.down[starts] + (ends - starts).astype(np.uint64), seed)


def window_hashes(words: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """64-bit hashes of all runs of ``size`` neighbouring words; text ends are the caller's matter."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    _WINDOWS.reach(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _WINDOWS.up[:len(words)], out=sums[1:])
    return mix((sums[size:] - sums[:n]) * _WINDOWS.down[:n], seed + 1)
