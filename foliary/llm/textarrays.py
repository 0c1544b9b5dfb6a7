"""Vectorised text primitives over a batch of texts.

A batch is one byte buffer and the offsets of its texts. Words are maximal
runs of bytes other than space and \\x09-\\x0D. Nothing here loops over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C55  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_PIECE = 1 << 20

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE_VALUE = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_powers = {1: np.ones(1, U64), -1: np.ones(1, U64)}


def _power(sign: int, n: int) -> np.ndarray:
    have = _powers[sign]
    if len(have) < n:
        step = np.full(max(n, 1 << 12), _BASE if sign == 1 else _INVERSE, U64)
        step[0] = 1
        have = np.cumprod(step)
        if n <= 2 * _PIECE:
            _powers[sign] = have
    return have[:n]


@dataclass
class Texts:
    """Texts end to end: `buf` holds their bytes, text i is buf[offsets[i]:offsets[i + 1]]."""

    buf: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def per_text(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each text are marked in `mask`."""
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def edges(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of `inside` that stay within a text."""
        if not len(inside):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        filled = self.offsets[:-1][np.diff(self.offsets) > 0]
        before = np.empty_like(inside)
        before[0] = False
        before[1:] = inside[:-1]
        before[filled] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[-1] = False
        after[:-1] = inside[1:]
        after[filled[1:] - 1] = False
        return starts, np.flatnonzero(inside & ~after) + 1


def from_arrow(column: pa.Array | pa.ChunkedArray) -> Texts:
    """Texts of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    buf = np.frombuffer(data, np.uint8, last)[first:] if data is not None and last > first else np.zeros(0, np.uint8)
    return Texts(buf, offsets - first)


def from_strings(texts: list[str | None]) -> Texts:
    return from_arrow(pa.array(texts, pa.large_string()))


def slices(column: pa.Array, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes of text; a longer text stands alone."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64)
    begin = size = 0
    for i, n in enumerate(sizes.tolist()):
        if i > begin and size + n > most:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(sizes):
        yield begin, len(sizes)


def hash_runs(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ascending, disjoint byte runs, by differences of one running polynomial."""
    out = np.empty(len(starts), U64)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        upto = max(at + 1, int(np.searchsorted(ends, base + _PIECE, "right")))
        low, high = starts[at:upto] - base, ends[at:upto] - base
        n = int(high[-1])
        total = np.zeros(n + 1, U64)
        np.cumsum(_BYTE_VALUE[buf[base : base + n]] * _power(1, n), out=total[1:])
        out[at:upto] = (total[high] - total[low]) * _power(-1, n + 1)[low] + (high - low).astype(U64)
        at = upto
    return mix64(out)


def words(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the range of its words (n + 1 bounds)."""
    starts, ends = texts.edges(~IS_SPACE[texts.buf])
    return starts, ends, np.searchsorted(starts, texts.offsets)


def windows(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all windows of `width` words that stay within a text.

    Returns the hash of each window, the index of its first word, and its text.
    """
    counts = np.diff(bounds)
    text = np.repeat(np.arange(len(counts)), counts)
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(text[:n] == text[width - 1 :])
    value = np.zeros(n, U64)
    for i in range(width):
        value *= U64(_BASE)
        value += hashes[i : i + n]
    return mix64(value[first]), first, text[first]


def shingle_sets(texts: Texts, width: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words is one shingle, one without words has none."""
    starts, ends, bounds = words(texts)
    hashes = hash_runs(texts.buf, starts, ends)
    value, _, text = windows(hashes, bounds, width)
    cuts = np.searchsorted(text, np.arange(len(texts) + 1))
    out = []
    for i in range(len(texts)):
        if cuts[i + 1] > cuts[i]:
            out.append(np.unique(value[cuts[i] : cuts[i + 1]]))
        elif bounds[i + 1] > bounds[i]:
            short = U64(0)
            with np.errstate(over="ignore"):
                for h in hashes[bounds[i] : bounds[i + 1]]:
                    short = short * U64(_BASE) + h
            out.append(mix64(np.array([short], U64) + U64(bounds[i + 1] - bounds[i])))
        else:
            out.append(np.zeros(0, U64))
    return out
