"""Word and window hashes of whole batches of texts, in numpy.

A word's hash is a polynomial of its bytes modulo 2**64, taken from prefix sums over the
batch and then mixed; a window's is the same over the hashes of its words. Work goes
slice by slice, so memory follows the slice (or the longest text), not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_STEP_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. n - 1 modulo 2**64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = _powers[int(base)] = np.cumprod(steps)
    return have[:n]


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) % (1 << 64))
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """Words of consecutive texts: ``first`` and ``last`` index the texts of the batch;
    ``offsets`` (one more than texts) cut the arrays of words."""

    first: int
    last: int
    offsets: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the offsets of the texts in them; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(pc.cast(texts, pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z of UTF-8 bytes in lower case."""
    return _LOWER[data]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``most`` bytes; a longer text is a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``data``; a border of texts ends a word."""
    inside = ~_IS_SPACE[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    borders = offsets[(offsets > 0) & (offsets < len(data))]
    before[borders] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[borders - 1] = False
    return starts, np.flatnonzero(inside & ~after) + 1


def words(texts: pa.Array, lower: bool = False) -> Iterator[Words]:
    """Hashes of all words of all texts, in slices."""
    data, offsets = buffers(texts)
    for i, j in slices(offsets):
        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        if lower:
            part = _LOWER[part]
        starts, ends = word_bounds(part, at)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(part)), out=sums[1:])
        hashes = (sums[ends] - sums[starts]) * _power(_BASE_INVERSE, len(part) + 1)[starts]
        yield Words(i, j, np.searchsorted(starts, at), mixed(hashes + (ends - starts).astype(np.uint64)))


def windows(hashes: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hash of the n words from each place on, also across texts; mask with :func:`whole`."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    own = hashes if salt == 0 else mixed(hashes, salt)
    np.cumsum(own * _power(_STEP, len(hashes)), out=sums[1:])
    return mixed((sums[n:] - sums[:-n]) * _power(_STEP_INVERSE, len(hashes))[: len(hashes) - n + 1], n)


def whole(offsets: np.ndarray, n: int) -> np.ndarray:
    """Places from which n words lie within one text."""
    counts = np.diff(offsets)
    left = np.repeat(offsets[1:], counts) - np.arange(offsets[-1])
    return np.flatnonzero(left >= n)
