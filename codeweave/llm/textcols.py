"""Words and word shingles of Arrow text columns, vectorised over whole batches.

A text is its UTF-8 bytes with A-Z in lower case; words are the runs of bytes other than 0x20 and 0x09-0x0D.
Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are worked on in runs of about so many bytes, which bounds a worker's memory and stays in cache.
RUN_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * M1
    x ^= x >> np.uint64(27)
    x *= M2
    x ^= x >> np.uint64(31)
    return x


def seeded(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit words."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 32)) * GOLD)


BYTE = seeded(256, 1)
_ODD = int(seeded(1, 2)[0]) | 1
_POW: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd constant and of its inverse modulo 2**64."""
    if not _POW or len(_POW[0]) < n:
        m = 1 << max(18, (n - 1).bit_length())
        _POW[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(m - 1, b % (1 << 64), np.uint64)])) for b in (_ODD, pow(_ODD, -1, 1 << 64))]
    return _POW[0], _POW[1]


def runs(column: pa.Array, limit: int = RUN_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0) of runs of rows of a string or binary column."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and len(column) else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, its row, first word of each row and the count of all) for a run of texts."""
    n, rows = len(data), len(offsets) - 1
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(rows + 1, np.int64)
    inside = ~SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < n]
    begins[cuts] = inside[cuts]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] = inside[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    power, inverse = powers(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(BYTE[LOWER[data]] * power[:n], out=total[1:])
    h = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(rows), np.diff(first))
    return h, row, first


def shingles(h: np.ndarray, first: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of `size` words, first shingle of each row and the count of all).

    A row of 1 to size-1 words has one shingle, all its words; a row without words has none.
    """
    n = np.diff(first)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    at = np.concatenate([[0], np.cumsum(count)])
    if not at[-1]:
        return np.zeros(0, np.uint64), at
    begin = np.repeat(first[:-1] - at[:-1], count) + np.arange(at[-1])
    left = np.repeat(np.minimum(n, size), count)
    padded = np.concatenate([h, np.zeros(size, np.uint64)])
    weight = seeded(size, 3) | np.uint64(1)
    out = np.zeros(len(begin), np.uint64)
    short = left < size
    any_short = bool(short.any())
    for k in range(size):
        part = padded[begin + k] * weight[k]
        if any_short:
            part[left <= k] = 0
        out += part
    return mix(out), at
