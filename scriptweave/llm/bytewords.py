"""Words of UTF-8 texts, found and hashed with numpy over whole Arrow batches.

All functions work on the bytes of an Arrow string column without making Python strings. A batch is
taken in slices of about ``SLICE_BYTES`` so that memory does not grow with the batch; a single text
longer than that is one slice, and needs some 60 bytes per byte of it.

Hashes take eight bytes at a time and mix each block before it is added, so no choice of letters makes
sums meet, as powers of one base do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): every input bit reaches every output bit."""
    x = np.array(x, dtype=np.uint64)
    moved = np.empty_like(x)
    x ^= np.right_shift(x, np.uint64(30), out=moved)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= np.right_shift(x, np.uint64(27), out=moved)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= np.right_shift(x, np.uint64(31), out=moved)
    return x


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return _LOWER[data]


@dataclass
class Texts:
    """Consecutive texts of a batch: their bytes, and where each begins (one more bound at the end)."""

    first: int
    data: np.ndarray
    bounds: np.ndarray

    @property
    def count(self) -> int:
        return len(self.bounds) - 1


def slices(column: pa.Array, lower: bool = False, size: int = SLICE_BYTES) -> Iterator[Texts]:
    """The texts of a string column in slices of about ``size`` bytes; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    _, offsets, values = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(values, dtype=np.uint8) if values is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(bounds, bounds[at] + size, side="right")) - 1
        to = min(n, max(to, at + 1))
        part = data[bounds[at] : bounds[to]]
        yield Texts(at, lowered(part) if lower else part, bounds[at : to + 1] - bounds[at])
        at = to


@dataclass
class Words:
    """The words of some texts, in order: first byte, byte behind the last, number of the text, and
    for each text its first word (one more bound at the end)."""

    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    bounds: np.ndarray


def words(texts: Texts, space: np.ndarray = _SPACE) -> Words:
    """Maximal runs of bytes that are not white space; no word crosses from one text to the next."""
    inside = ~space[texts.data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = texts.bounds[(texts.bounds > 0) & (texts.bounds < len(inside))]
    begins[edges] |= inside[edges]
    ends[edges - 1] |= inside[edges - 1]
    starts = np.flatnonzero(begins)
    bounds = np.searchsorted(starts, texts.bounds)
    text = np.repeat(np.arange(texts.count), np.diff(bounds))
    return Words(starts, np.flatnonzero(ends) + 1, text, bounds)


def eights(data: np.ndarray) -> np.ndarray:
    """At each byte the number made of it and the seven behind it; zeros follow the last."""
    code = data.astype(np.uint64)
    for k in (1, 2, 4):
        if len(code) > k:
            code[:-k] |= code[k:] << np.uint64(8 * k)
    return code


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
# Longer words, which are rare, are hashed one by one.
_BLOCKS = 32


def word_hashes(texts: Texts, w: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same wherever the word stands."""
    lengths = w.ends - w.starts
    out = mix(lengths.astype(np.uint64) * _BASE)
    if not len(lengths):
        return out
    codes = eights(texts.data)
    open_ = np.flatnonzero(lengths <= 8 * _BLOCKS)
    for k in range(_BLOCKS):
        if k:
            open_ = open_[lengths[open_] > 8 * k]
        if not len(open_):
            break
        block = codes[w.starts[open_] + 8 * k] & _MASKS[np.minimum(lengths[open_] - 8 * k, 8)]
        out[open_] = mix(out[open_] * _BASE + mix(block + np.uint64(k + 1)))
    for i in np.flatnonzero(lengths > 8 * _BLOCKS):
        found = hashlib.blake2b(texts.data[w.starts[i] : w.ends[i]].tobytes(), digest_size=8).digest()
        out[i] = np.frombuffer(found, dtype=np.uint64)[0]
    return out


def shingle_hashes(hashes: np.ndarray, w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words inside one text, repeats kept, and the first word of each run.

    A text of fewer words, but not none, is one run.
    """
    n = len(hashes)
    counts = np.diff(w.bounds)
    left = np.repeat(w.bounds[1:], counts) - np.arange(n)
    used = np.minimum(left, size)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        part = np.zeros(n, dtype=np.uint64)
        part[: max(0, n - k)] = hashes[k:]
        out = np.where(used > k, mix(out * _BASE + part + np.uint64(k + 1)), out)
    heads = np.zeros(n, dtype=bool)
    heads[w.bounds[:-1][counts > 0]] = True
    first = np.flatnonzero((left >= size) | (heads & (np.repeat(counts, counts) < size)))
    return out[first], first


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive bounds."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]
