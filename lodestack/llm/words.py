"""Hashes of the words of many texts at once, in numpy.

Words are maximal runs of bytes other than space and 0x09-0x0D, with A-Z in
lower case. A word's hash is a polynomial in its bytes modulo 2**64, taken as a
difference of prefix sums, so that no Python loop runs over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time.
SEGMENT = 1 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = SEGMENT + 1
    up, down = np.full(n, BASE, np.uint64), np.full(n, INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit (the finalizer of SplitMix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hash_words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first bytes) of the words in data, at most SEGMENT bytes; a word never crosses one of the starts."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, down = _powers()
    inside = IS_WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = starts[(starts > 0) & (starts < n)]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    b, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    return mix((sums[e] - sums[b]) * down[b] + (e - b).astype(np.uint64)), b


def _long_text(data: np.ndarray) -> np.ndarray:
    """Word hashes of one text of any length: pieces end between words; a longer word is folded piece by piece."""
    out, at, n = [], 0, len(data)
    while at < n:
        end = min(at + SEGMENT, n)
        if end < n and IS_WORD[data[end]] and IS_WORD[data[end - 1]]:
            gaps = np.flatnonzero(~IS_WORD[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:  # a word longer than a piece
                rest = np.flatnonzero(~IS_WORD[data[end:]])
                stop = end + int(rest[0]) if len(rest) else n
                h = np.zeros(1, np.uint64)
                for k in range(at, stop, SEGMENT):
                    h = mix(h + hash_words(data[k : min(k + SEGMENT, stop)], np.zeros(0, np.int64))[0])
                out.append(h)
                at = stop
                continue
        out.append(hash_words(data[at:end], np.zeros(0, np.int64))[0])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def text_words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, word hashes, row of each word counted from the first) over pieces of a string column; nulls are empty."""
    column = column.fill_null("") if column.null_count else column
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    if len(column) == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = int(np.searchsorted(offsets, offsets[row] + SEGMENT, side="right")) - 1
        if stop <= row:
            h = _long_text(data[offsets[row] : offsets[row + 1]])
            yield row, 1, h, np.zeros(len(h), np.int64)
            row += 1
        else:
            starts = offsets[row : stop + 1] - offsets[row]
            h, b = hash_words(data[offsets[row] : offsets[stop]], starts[:-1])
            yield row, stop - row, h, np.searchsorted(starts[1:], b, side="right")
            row = stop
