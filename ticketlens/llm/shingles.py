"""Words, word windows and minhash signatures in numpy, for the texts of one Arrow batch at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BLOCK = 1 << 20
_BLANKS = np.zeros(256, bool)
_BLANKS[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def numbers(n: int, seed: int) -> np.ndarray:
    """``n`` fixed 64-bit numbers that look random."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


class WordHasher:
    """64-bit hashes of the words of many texts at once.

    A word's hash is the sum over its bytes of the byte's number times the number of its place in the word, all of them fixed 64-bit
    numbers that look random. Unlike powers of one base, they give equal sums for different words by chance only, once in about 2^57. The
    bytes of a block of neighbouring texts are summed at once, so that no word becomes a Python object. Words are runs without ASCII blanks;
    ``lower`` folds A-Z.
    """

    def __init__(self, lower: bool):
        self.values = numbers(256, 11)
        if lower:
            self.values = self.values[_LOWER]
        self.places = numbers(1 << 10, 23)

    def block(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words of neighbouring texts that begin at ``starts`` of ``data``, and the first word of each."""
        n = len(data)
        if n == 0:
            return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
        inside = ~_BLANKS[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cuts = starts[(starts > 0) & (starts < n)]
        first[cuts] = inside[cuts]
        last[cuts - 1] = inside[cuts - 1]
        begin, end = np.flatnonzero(first), np.flatnonzero(last)
        if not len(begin):
            return np.zeros(0, np.uint64), np.searchsorted(begin, starts)
        size = end - begin + 1
        if size.max() > len(self.places):
            self.places = numbers(2 * int(size.max()), 23)
        letters = np.flatnonzero(inside)
        heads = np.cumsum(size) - size  # where each word's bytes begin among all bytes of words
        place = np.arange(len(letters)) - np.repeat(heads, size)
        sums = np.add.reduceat(self.values[data[letters]] * self.places[place], heads)
        return mix(sums + size.astype(np.uint64)), np.searchsorted(begin, starts)

    def texts(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of texts: word hashes, and where each text's words begin and end in them. Null is an empty text."""
        offsets, data = text_bytes(column)
        at = 0
        while at < len(column):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _BLOCK, "right")) - 1)
            starts = offsets[at:to] - offsets[at]
            hashes, begin = self.block(data[offsets[at] : offsets[to]], starts)
            yield hashes, np.append(begin, len(hashes))
            at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a text column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """One hash for each run of ``size`` neighbouring words; none if there are fewer words."""
    n = max(0, len(hashes) - size + 1)
    total = np.zeros(n, np.uint64)
    for i, factor in enumerate(numbers(size, 5) | np.uint64(1)):
        total += hashes[i : n + i] * factor
    return mix(total + np.uint64(size))


def shingle_sets(column: pa.Array, hasher: WordHasher, size: int) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles; a shorter text is one shingle, one without words has none."""
    for hashes, begin in hasher.texts(column):
        runs = windows(hashes, size)
        for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
            if b - a >= size:
                yield np.unique(runs[a : b - size + 1])
            else:
                yield windows(hashes[a:b], b - a) if b > a else hashes[:0]


def signature(shingles: np.ndarray, factors: np.ndarray, kind: type = np.uint16, block: int = 2048) -> np.ndarray:
    """Minhash symbols of a set, the top bits of one minimum for each factor. Two sets agree in a symbol with the
    probability of their Jaccard similarity (besides chance equality of the bits)."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), block):
        part = shingles[start : start + block]
        np.minimum(least, ((part ^ (part >> np.uint64(32)))[None, :] * factors[:, None]).min(axis=1), out=least)
    return (mix(least) >> np.uint64(64 - 8 * np.dtype(kind).itemsize)).astype(kind)
