"""Words and runs of words of many texts at once, as 64-bit hashes (NumPy on Arrow buffers).

A word is a run of bytes other than space and 0x09-0x0D.  A word's hash adds up one random value for each
pair of place and byte; a run of words is hashed by halves, each step a mixing one.  So no pattern in a
text makes two hashes equal more often than random bits are.  (``run_hashes`` is a polynomial modulo
2**64, for short runs only: long periodic ones can cancel out in it.)  Texts are taken in slices of about
a megabyte: memory doesn't follow the batch size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits."""
    out = x >> np.uint64(30)
    out ^= x
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(27)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(31)
    return out


IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
BYTE_VALUE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _STEP)

PLACES = 256
PLACE_VALUE = mix((np.arange(PLACES * 256, dtype=np.uint64) + np.uint64(1)) * _STEP)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start : end] for each word; words don't overlap and none is empty."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    ends = np.cumsum(size)
    place = np.arange(ends[-1]) - np.repeat(ends - size, size)
    cell = place * 256 + data[np.repeat(start, size) + place]
    values = PLACE_VALUE[np.minimum(cell, len(PLACE_VALUE) - 1)]
    late = np.flatnonzero(place >= PLACES)
    values[late] = mix((cell[late].astype(np.uint64) + np.uint64(1)) * _STEP)
    return mix(np.add.reduceat(values, ends - size) + size.astype(np.uint64) * _STEP)


def joined_hashes(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Hash of two things after one another, from their hashes."""
    turned = two << np.uint64(32)
    turned |= two >> np.uint64(32)
    turned ^= one * np.uint64(_BASE)
    return mix(turned)


def window_hashes(values: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """Hash of values[i : i + length] for every i; another seed gives an independent hash."""
    if len(values) < length:
        return np.zeros(0, np.uint64)
    part, size = (mix(values + np.uint64(seed) * _STEP) if seed else values), 1  # hashes of runs of ``size`` values
    out, done = None, 0
    while True:
        if length & size:
            out = part if out is None else joined_hashes(out[: len(values) - done - size + 1], part[done:])
            done += size
        if done == length:
            return out[: len(values) - length + 1]
        part = joined_hashes(part[:-size], part[size:])
        size *= 2


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse; kept between calls."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            up = np.full(size, base, np.uint64)
            up[0] = 1
            _powers[k] = np.cumprod(up, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def run_hashes(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hash of values[start : start + length] for each pair; equal runs have equal hashes."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return mix((sums[start + length] - sums[start]) * down[start] + length.astype(np.uint64) * _STEP)


@dataclass
class Words:
    """Words of one slice: hash and byte range of each; document d holds first[d]:first[d+1]."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words_of(data: np.ndarray, offsets: np.ndarray, fold: bool) -> Words:
    """The words of texts laid end to end; ``fold`` lower-cases A-Z first."""
    inside = ~IS_SPACE[data]
    begin, finish = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    finish[:-1] &= ~inside[1:]
    full = np.flatnonzero(np.diff(offsets))
    begin[offsets[full]] = inside[offsets[full]]
    finish[offsets[full + 1] - 1] = inside[offsets[full + 1] - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    hashes = word_hashes(FOLD[data] if fold else data, start, end)
    return Words(hashes, start, end, np.searchsorted(start, offsets))


def shingles(words: Words, k: int, whole_if_short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of k words, their first word, and where each document's runs begin.

    A document with fewer words than k has its whole sequence as the only run, or no run.
    """
    owner = words.owner()
    room = words.first[owner + 1] - np.arange(len(owner))
    keep = room >= k
    if whole_if_short:
        keep |= (words.counts[owner] < k) & (room == words.counts[owner])
    index = np.flatnonzero(keep)
    hashes = np.zeros(len(index), np.uint64)
    whole = room[index] >= k
    hashes[whole] = window_hashes(words.hash, k)[index[whole]]
    first, count = index[~whole], room[index[~whole]]
    short = words.hash[first]
    for place in range(1, k - 1):
        more = count > place
        short[more] = joined_hashes(short[more], words.hash[first[more] + place])
    hashes[~whole] = mix(short + count.astype(np.uint64) * _STEP)
    return hashes, index, np.searchsorted(index, words.first)


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into row ranges of about ``limit`` bytes: (low, high, bytes, offsets).

    A null counts as the empty text; a text over the limit is a slice of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, places, body = column.buffers()
    offsets = np.frombuffer(places, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def distinct_runs(hashes: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct hashes of each document."""
    out = []
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        run = np.sort(hashes[low:high])
        out.append(run[np.concatenate(([True], run[1:] != run[:-1]))] if len(run) else run)
    return out


def lists(parts: list[np.ndarray], kind: type = np.int64) -> pa.Array:
    """An Arrow list column from one array per row."""
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, kind)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(kind)))
