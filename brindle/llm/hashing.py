"""Vectorised words and hashes of many texts at once, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once; a longer text is a piece of its own.
AT_ONCE = 500_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: White space and ASCII punctuation, for words without what stands at their ends.
BREAKS = _SPACE.copy()
BREAKS[33:48] = BREAKS[58:65] = BREAKS[91:97] = BREAKS[123:127] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS = np.ones(1, np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> np.ndarray:
    """_BASE ** 0 .. n modulo 2 ** 64; kept and grown as needed."""
    global _POWERS
    if len(_POWERS) <= n:
        grown = np.full(max(n + 1, 1 << 16), _BASE, np.uint64)
        grown[0] = 1
        _POWERS = np.multiply.accumulate(grown)
    return _POWERS[: n + 1]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """h with h[j] - h[i] * powers[j - i] a polynomial hash of data[i:j] modulo 2 ** 64, by doubling."""
    n = len(data)
    # s[i] = sum of data[k] * base ** -k; multiplied back by base ** i it is the usual prefix hash.
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    down = np.full(n + 1, inverse, np.uint64)
    down[0] = 1
    down = np.multiply.accumulate(down)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down[1:], out=sums[1:])
    return sums * powers(n)


def words(buffer: np.ndarray, bounds: np.ndarray, breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, start) of each lower-cased word of the texts buffer[bounds[i]:bounds[i + 1]]."""
    low = _LOWER[buffer]
    inside = ~breaks[low]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(buffer))]
    first[edges] |= inside[edges]  # words don't run on from one text into the next
    last[edges - 1] |= inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    h = prefix_hashes(low)
    size = ends - starts
    p = powers(int(size.max()) if len(size) else 0)
    code = mix64((h[ends] - h[starts] * p[size]) ^ (size.astype(np.uint64) << np.uint64(56)))
    text = np.searchsorted(bounds, starts, side="right") - 1
    return code, text, starts


def pieces(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of its first text, bytes, bounds) of runs of texts of about AT_ONCE bytes; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + AT_ONCE, side="right")) - 1)
        j = min(j, len(texts))
        yield i, data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
        i = j
