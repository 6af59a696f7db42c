"""Words and word n-grams of whole Arrow text batches, as numpy arrays.

A word is a maximal run of bytes other than space and 0x09-0x0D.  UTF-8 never
uses those bytes inside a character, so the split works on the raw Arrow buffer
and no Python string is made.  Every name is a 64-bit hash of the content: equal
words get equal names in every task, with no dictionary to share.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
#: Names by this table are independent of the usual ones: both together are names of 128 bits.
OTHER = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_BASE, _WORD_BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: Bytes hashed at a time; bounds the working memory to about 40 times this.
CHUNK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (odd bases have inverses)."""
    key = int(base)
    if key not in _TABLES or len(_TABLES[key][0]) < n:
        size = max(n, CHUNK + 1)
        up, down = (np.full(size, x, np.uint64) for x in (base, pow(key, -1, 2**64)))
        up[0] = down[0] = 1
        _TABLES[key] = np.cumprod(up), np.cumprod(down)
    up, down = _TABLES[key]
    return up[:n], down[:n]


@dataclass
class Words:
    """names: one hash per word; first[d]..first[d+1]: the words of document d."""

    names: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def room(self) -> np.ndarray:
        """For each word, the words from it to the end of its document."""
        return np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self.names))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and its offsets; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """The hash of each byte span; spans are in order and don't overlap."""
    names = np.empty(len(start), np.uint64)
    k = 0
    while k < len(start):  # a slice of whole spans at a time
        stop = max(int(np.searchsorted(start, start[k] + CHUNK)), k + 1)
        lo, hi = int(start[k]), int(end[stop - 1])
        up, down = _powers(_BASE, hi - lo + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(table[data[lo:hi]] * up[: hi - lo], out=sums[1:])
        s, e = start[k:stop] - lo, end[k:stop] - lo
        names[k:stop] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        k = stop
    return names


def words(texts: pa.Array, lower: bool = False) -> Words:
    """The words of each text.  lower folds A-Z before naming."""
    data, offsets = buffers(texts)
    n = len(data)
    space = _SPACE[data]
    begins = np.empty(n, bool)
    if n:
        begins[0] = True
        begins[1:] = space[:-1]
        begins[offsets[:-1][offsets[:-1] < n]] = True
        begins &= ~space
    ends = np.empty(n, bool)
    if n:
        ends[-1] = True
        ends[:-1] = space[1:]
        inner = offsets[1:-1]
        ends[inner[(inner > 0) & (inner < n)] - 1] = True
        ends &= ~space
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    names = spans(data, start, end, _LOWER if lower else _BYTE)
    return Words(names, np.searchsorted(start, offsets), start, end, data)


def grams(names: np.ndarray, n: int) -> np.ndarray:
    """The hash of each n consecutive names; the last n-1 entries are absent."""
    count = len(names) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    scale = np.uint64(1)
    with np.errstate(over="ignore"):
        for i in range(n):
            out += names[i : i + count] * scale
            scale *= _WORD_BASE
    return mix(out)


def slices(texts: pa.Array, limit: int = 1 << 20):
    """Ranges of rows that hold about limit bytes of text each (one row at least)."""
    _, offsets = buffers(texts)
    k, n = 0, len(offsets) - 1
    while k < n:
        stop = max(int(np.searchsorted(offsets, offsets[k] + limit, "right")) - 1, k + 1)
        yield k, stop
        k = stop
