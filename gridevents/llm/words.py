"""Words of Arrow string columns as flat numpy arrays.

A word is a run of bytes other than space and 09-0D, so word borders can be read
off the UTF-8 bytes of a whole batch at once, without a Python object per word.
All hashes are 64 bits; equal hashes are taken for equal words or shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; bounds the temporaries (about 40 bytes per byte of text).
SLICE_BYTES = 1 << 20

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Random odd multiplier per byte position inside a word, and random value per byte.
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = 4096
_PLACE = _RNG.integers(1, 1 << 63, _STEP, dtype=np.uint64) | _U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (constants of SplitMix64)."""
    t = x >> _U(30)
    x = x ^ t
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= np.right_shift(x, _U(27), out=t)
    x *= _U(0x94D049BB133111EB)
    x ^= np.right_shift(x, _U(31), out=t)
    return x


@dataclass
class Words:
    """Words of consecutive texts: ``data`` are the bytes, ``text`` bounds the texts in it."""
    data: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    #: Index of the first word of each text, with the total at the end.
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash per word; ``lower`` folds A-Z only."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        data = self.data
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + 32, data)
        inside = ~_SPACE[data]
        letters = data[inside]
        length = self.end - self.start
        begin = np.cumsum(length) - length
        place = np.arange(len(letters)) - np.repeat(begin, length)
        value = _BYTE[letters]
        if length.max() > _STEP:
            value = mix(value + (place // _STEP).astype(np.uint64))
            place %= _STEP
        value *= _PLACE[place]
        return mix(np.add.reduceat(value, begin) + length.astype(np.uint64))


def words(column: pa.Array) -> Words:
    """Words of a string array; nulls count as empty."""
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if column.null_count:
        column = column.fill_null("")
    buffers = column.buffers()
    bounds = np.frombuffer(buffers[1], np.int64, len(column) + 1 + column.offset)[column.offset:]
    data = np.frombuffer(buffers[2] or b"", np.uint8)[bounds[0]:bounds[-1]]
    text = bounds - bounds[0]
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~_SPACE[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    before[text] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside[1:]
    after[text[1:][text[1:] > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return Words(data, text, start, end, np.searchsorted(start, text))


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``size`` bytes of text each (one text at least)."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch[column]), 0), np.int64)
    part = np.cumsum(lengths) // size
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of ``size`` words inside a text, and the window's first word.

    A text with some words but fewer than ``size`` has one window, all of its words.
    """
    counts = np.diff(first)
    total = len(hashes)
    if not total:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    left = np.repeat(first[1:], counts) - np.arange(total)
    value = np.zeros(total, np.uint64)
    for i in range(size):
        part = mix(padded[i:i + total] + _PLACE[i])
        value = value * _PLACE[-1] + (part if not i else np.where(left > i, part, _U(0)))
    whole = (left >= size) | ((np.repeat(counts, counts) < size) & (left == np.repeat(counts, counts)))
    at = np.flatnonzero(whole)
    return mix(value[at]), at


def code_points(data: np.ndarray) -> np.ndarray:
    """Code points before each byte position (one entry more than bytes)."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
