"""Whole batches of texts as flat numpy arrays: words, their hashes, rolling windows and minimizers.

Texts are looked at as UTF-8 bytes. Words are runs of anything but ASCII white space, so byte positions are all they need.
Work goes in slices of some MB, so memory doesn't follow the batch size; one text longer than a slice is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SLICE = 2_000_000
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finish: spreads every bit over all 64."""
    with np.errstate(over="ignore"):
        x = x + U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def _byte_values(seed: int) -> np.ndarray:
    return mix(np.arange(256, dtype=U) + U(1 + 1000 * seed))


def powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, U)
    if n:
        p[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(p, dtype=U)


#: Odd multipliers and their inverses modulo 2**64.
BASES = [0x9E3779B97F4A7C15, 0xD1342543DE82EF95]
INVERSES = [pow(b, -1, 1 << 64) for b in BASES]


class Rolling:
    """Hashes of all windows of a sequence of 64-bit values, by prefix sums."""

    def __init__(self, values: np.ndarray, which: int = 0):
        n = len(values)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(n + 1, U)
            np.cumsum(values * powers(BASES[which], n), dtype=U, out=self.sums[1:])
        self.inverse = powers(INVERSES[which], n + 1)

    def windows(self, starts: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[starts + length] - self.sums[starts]) * self.inverse[starts])


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for slices of the rows; nulls are empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    if len(texts) == 0:
        return
    data = texts.cast(pa.large_binary()).fill_null(b"")
    bufs = data.buffers()
    offsets = np.frombuffer(bufs[1], np.int64, len(data) + 1, data.offset * 8)
    raw = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(data):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, end, raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


class Words:
    """start, end: byte positions of each word; row: of its text; first[r]: index of row r's first word; h: hashes."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, lower: bool = False, seeds: int = 1):
        self.raw = LOWER[raw] if lower else raw
        word = ~SPACE[raw]
        starts, ends = word.copy(), word.copy()
        if len(raw):
            starts[1:] &= ~word[:-1]
            ends[:-1] &= ~word[1:]
            cut = offsets[1:-1]
            cut = cut[(cut > 0) & (cut < len(raw))]
            starts[cut] = word[cut]
            ends[cut - 1] = word[cut - 1]
        self.start, self.end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.h = [self._hashes(word, s) for s in range(seeds)]

    def _hashes(self, word: np.ndarray, seed: int) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, U)
        length = self.end - self.start
        at = np.flatnonzero(word)  # words lie without gaps in this order
        place = np.arange(len(at)) - np.repeat(np.cumsum(length) - length, length)
        with np.errstate(over="ignore"):
            v = _byte_values(seed)[self.raw[at]] * powers(BASES[seed], int(length.max()))[place]
            return mix(np.add.reduceat(v, np.cumsum(length) - length) + length.astype(U))


def windows_within(first: np.ndarray, size: int) -> np.ndarray:
    """Starts of all runs of `size` items that stay within one row; first[r], first[r+1] bound row r."""
    n = np.maximum(np.diff(first) - size + 1, 0)
    return np.repeat(first[:-1] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each i the rightmost place of the least of values[i : i + width]; values are distinct but for equal content."""
    n = len(values)
    if n < width or n == 0:
        return np.zeros(0, np.int64)
    low, span = values, 1
    where = np.arange(n, dtype=np.int64)
    while span < width:
        step = min(span, width - span)
        a, b = low[: len(low) - step], low[step:]
        right = b <= a
        where = np.where(right, where[step:], where[: len(where) - step])
        low = np.where(right, b, a)
        span += step
    return where


def in_parts(keys: np.ndarray, bits: int) -> dict[int, tuple[int, int]]:
    """For each part of the key space (its number: the keys' first bits) that has any of the sorted keys, where they begin and end."""
    part = keys >> U(64 - bits)
    if not len(part):
        return {}
    begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    return dict(zip(part[begin].tolist(), zip(begin.tolist(), [*begin[1:].tolist(), len(part)], strict=True), strict=True))


def packed(values: np.ndarray) -> bytes:
    """Integers as zstd bytes, byte by byte of their places; sorted ones as differences pack best."""
    import zstandard

    v = np.ascontiguousarray(values)
    return zstandard.ZstdCompressor(level=1).compress(v.view(np.uint8).reshape(len(v), v.itemsize).T.tobytes() if len(v) else b"")


def unpacked(data: bytes, dtype, n: int) -> np.ndarray:
    import zstandard

    if n == 0:
        return np.zeros(0, dtype)
    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=n * size), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, n).T).reshape(-1).view(dtype)
