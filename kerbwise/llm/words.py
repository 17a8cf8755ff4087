"""Words of whole texts as hashed arrays, straight from Arrow buffers.

A word is a maximal run of bytes other than blank, tab, line feed, vertical tab, form feed
and carriage return (UTF-8 never holds those inside a longer character). Each word becomes
a 64-bit number, a polynomial of its bytes that is mixed afterwards, so that shingles and
windows are built by array arithmetic and no word is ever a Python object.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_U = np.uint64
_BASE, _STEP = 0x9E3779B97F4A7C55, 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        row = np.full(max(n, CHUNK_BYTES) + 1, base, _U)
        row[0] = 1
        have = _powers[base] = np.multiply.accumulate(row)
    return have[: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all output bits (a bijection of 64-bit numbers)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@functools.cache
def _trim() -> Callable | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory to the system: workers live on between tasks, and what they keep is missing to others."""
    pa.default_memory_pool().release_unused()
    if _trim():
        _trim()(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run``, a function of a partition's batches, with freed memory returned at its end."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def tidy_group(run: Callable[[pa.Table], pa.Table]) -> Callable:
    """``run``, a function of a group's rows, with freed memory returned at its end."""

    def tidied(table: pa.Table) -> pa.Table:
        out = run(table)
        give_back()
        return out

    return tidied


@dataclass
class Words:
    """Words of consecutive texts. ``bounds[i]:bounds[i + 1]`` are the words of text ``first + i``."""

    first: int
    bounds: np.ndarray
    hashes: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1


def string_parts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offset of each; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return np.frombuffer(data or b"", np.uint8), offsets


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Whole texts in runs of about ``size`` bytes: first row, bytes, offsets from 0."""
    data, offsets = string_parts(texts)
    row, last = 0, len(offsets) - 1
    while row < last:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(texts: pa.Array, lower: bool = False) -> Iterator[Words]:
    """Hashed words of every text; ``lower`` folds A-Z."""
    for row, data, offsets in chunks(texts):
        if lower:
            data = _LOWER[data]
        n = len(data)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = ~_SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
        ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
        run = np.zeros(n + 1, _U)
        np.cumsum(data * powers(n)[:-1], out=run[1:])
        inverse = powers(n, pow(_BASE, -1, 1 << 64))
        hashes = mix((run[ends] - run[starts]) * inverse[starts] + (ends - starts).astype(_U) * _U(_STEP))
        yield Words(row, np.searchsorted(starts, offsets), hashes, data, starts, ends)


def combine(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive entries; entry i covers i .. i + k - 1."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    total = np.zeros(n, _U)
    for j in range(k):
        total *= _U(_STEP)
        total += hashes[j : j + n]
    return mix(total)


def shingle_sets(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingle hashes of each text, one after another, and their bounds.

    A text with fewer than k words has its whole sequence as one shingle; one without words has none.
    """
    counts = np.diff(w.bounds)
    whole = combine(w.hashes, k)
    owner = np.repeat(np.arange(len(w)), np.maximum(counts - k + 1, 0))
    first = np.repeat(w.bounds[:-1], np.maximum(counts - k + 1, 0))
    base = np.cumsum(np.maximum(counts - k + 1, 0))
    place = np.arange(len(owner)) - np.repeat(base - np.maximum(counts - k + 1, 0), np.maximum(counts - k + 1, 0)) + first
    values = whole[place] if len(place) else np.zeros(0, _U)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        extra = np.zeros(len(short), _U)
        for i, d in enumerate(short):
            part = w.hashes[w.bounds[d] : w.bounds[d + 1]]
            extra[i] = mix(combine(part, len(part)) + _U(len(part)))[0]
        values, owner = np.concatenate([values, extra]), np.concatenate([owner, short])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[keep], owner[keep]
    return values, np.searchsorted(owner, np.arange(len(w) + 1))
