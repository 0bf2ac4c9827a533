"""Vectorised word hashing over Arrow string buffers.

Words are maximal runs of bytes other than space and tab..carriage return,
read straight from the UTF-8 buffer of an Arrow column, so no Python string is
made for any of them.  A batch is walked in slices of bounded size; a single
text longer than a slice forms a slice of its own, hashed in stretches that end
at gaps, so beyond its words (24 bytes each) it needs no more memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; bounds the working memory of one task.
SLICE_BYTES = 1 << 18

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def seeds(n: int, seed: int) -> np.ndarray:
    """``n`` pseudo-random 64-bit integers by rule."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1_000_003)) * _STEP)


class _Powers:
    """Powers of an odd base modulo 2^64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base = np.uint64(base)
        self.inverse = np.uint64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, base in (("up", self.base), ("down", self.inverse)):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_BYTES = _Powers(0x9E3779B97F4A7C15)
_WORDS = _Powers(0xD1342543DE82EF95)


def _byte_codes(lower: bool) -> np.ndarray:
    codes = seeds(256, 17)
    if lower:
        codes[65:91] = codes[97:123]
    return codes


_CODES = {flag: _byte_codes(flag) for flag in (False, True)}
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: With signs as gaps too, a word is a run of letters, digits and bytes beyond ASCII.
_SIGNS = _SPACE.copy()
_SIGNS[[c for c in range(128) if not chr(c).isalnum()]] = True


@dataclass
class Words:
    """The words of some consecutive texts.

    ``hash`` holds a 64-bit hash of each word, ``start`` and ``end`` its bytes
    in ``data``, and text ``i`` owns the words ``bounds[i]:bounds[i + 1]``.
    """

    data: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every window of ``n`` words inside one text, and the index of its first word."""
        return rolling(self.hash, self.bounds, n)


def rolling(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Karp-Rabin hashes of all windows of ``n`` values that stay inside one text."""
    m = len(hashes)
    if m < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, down = _WORDS.get(m + 1)
    total = np.zeros(m + 1, np.uint64)
    np.cumsum(hashes * up[:m], out=total[1:])
    first = np.arange(m - n + 1)
    inside = np.ones(m - n + 1, bool)
    for k in range(1, n):  # a window must not contain the start of a later text
        edges = bounds[1:-1] - k
        inside[edges[(edges >= 0) & (edges < len(inside))]] = False
    first = first[inside]
    return mix((total[first + n] - total[first]) * down[first]), first


def span_hashes(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Karp-Rabin hashes of the spans ``[start, end)`` of a sequence, which may differ in length."""
    m = len(hashes)
    up, down = _WORDS.get(m + 1)
    total = np.zeros(m + 1, np.uint64)
    np.cumsum(hashes * up[:m], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of the spans ``[start, end)`` of some bytes."""
    n = len(data)
    up, down = _BYTES.get(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_CODES[lower][data] * up[:n], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def hash_words(data: np.ndarray, offsets: np.ndarray, lower: bool, signs: bool = False, stretch: int = 2 * SLICE_BYTES) -> Words:
    """Words of the texts ``data[offsets[i]:offsets[i + 1]]``; ``offsets`` starts at 0."""
    gaps = _SIGNS if signs else _SPACE
    parts, a, n = [], 0, len(data)
    while not parts or a < n:
        b = min(n, a + stretch)
        step = 1024
        while b < n and not gaps[data[b]]:  # on to the next gap
            near = np.flatnonzero(gaps[data[b : b + step]])
            b = b + int(near[0]) if len(near) else min(n, b + step)
            step *= 2
        h, start, end = _hash_stretch(data[a:b], np.unique(np.clip(offsets, a, b)) - a, lower, gaps)
        parts.append((h, start + a, end + a))
        a = b
    h, start, end = parts[0] if len(parts) == 1 else map(np.concatenate, zip(*parts, strict=True))
    return Words(data, h, start, end, np.searchsorted(start, offsets).astype(np.int64))


def _hash_stretch(data: np.ndarray, edge: np.ndarray, lower: bool, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word; no word spans one of the places ``edge``."""
    n = len(data)
    gap = gaps[data]
    head = ~gap
    tail = ~gap
    if n:
        head[1:] &= gap[:-1]
        tail[:-1] &= gap[1:]
        edge = edge[(edge > 0) & (edge < n)]
        head[edge] = ~gap[edge]
        tail[edge - 1] = ~gap[edge - 1]
    start = np.flatnonzero(head)
    end = np.flatnonzero(tail) + 1
    return hash_spans(data, start, end, lower), start, end


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its texts; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of texts ``i:j`` of at most ``limit`` bytes together, or of one text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def word_slices(
    column: pa.Array, lower: bool, signs: bool = False, limit: int = SLICE_BYTES
) -> Iterator[tuple[int, int, Words]]:
    """``(i, j, words of the texts i:j)`` over a whole column."""
    data, offsets = text_buffers(column)
    for i, j in slices(offsets, limit):
        at = offsets[i : j + 1]
        yield i, j, hash_words(data[at[0] : at[-1]], at - at[0], lower, signs)


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from concatenated values and the length of each list."""
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))
