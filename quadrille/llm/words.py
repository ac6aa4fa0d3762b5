"""Numpy helpers inside tasks: words of Arrow text batches, their hashes, and hashes of runs of words.

All of it works on half a MB of text at once, which takes about 40 times that in memory; a longer text is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE, _STEP = U(0x9E3779B97F4A7C15 | 1), U(0xD1342543DE82EF95)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

IS_WORD = np.ones(256, dtype=bool)  # all but the six ASCII white-space characters
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
IS_LETTER = np.zeros(256, dtype=bool)  # letters, digits, and all beyond ASCII
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    IS_LETTER[_a:_b] = True

#: ASCII capitals as small letters, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i < n, at least."""
    if (have := _POWERS.get(int(base))) is None or len(have[0]) < n:
        n = max(n, 1 << 16)
        both = []
        for b in (int(base), pow(int(base), -1, 1 << 64)):
            x = np.full(n, U(b))
            x[0] = 1
            both.append(np.cumprod(x, dtype=U))
        _POWERS[int(base)] = have = (both[0], both[1])
    return have


class Rolling:
    """Hashes of any stretches of a sequence, from one pass over it."""

    def __init__(self, values: np.ndarray, base: np.uint64 = _BASE):
        self.up, self.down = powers(base, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, dtype=U)
        np.cumsum(values * self.up[: len(values)], out=self.sums[1:], dtype=U)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U))


@dataclass
class Words:
    data: np.ndarray  # bytes of the chunk
    offsets: np.ndarray  # of its texts, one more than texts
    start: np.ndarray  # of words, in bytes
    end: np.ndarray
    first: np.ndarray  # of each text's first word, one more than texts
    rolling: Rolling  # over bytes

    def hashes(self) -> np.ndarray:
        return self.rolling.of(self.start, self.end)

    def docs(self) -> np.ndarray:
        """Each word's text."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))


def runs(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside one text: those of each text in order, and each text's first, one more than texts.

    A text of 1 to k - 1 words has one run, of all its words.
    """
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    begin = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(begin[-1]) - np.repeat(begin[:-1] - first[:-1], count)
    end = np.minimum(at + k, np.repeat(first[1:], count))
    return Rolling(hashes, _STEP).of(at, end), begin


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def split(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = IS_WORD) -> Words:
    is_in = inside[data]
    before = np.concatenate([[False], is_in[:-1]]) if len(data) else is_in
    after = np.concatenate([is_in[1:], [False]]) if len(data) else is_in
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    before[cuts] = False
    after[cuts - 1] = False
    start, end = np.flatnonzero(is_in & ~before), np.flatnonzero(is_in & ~after) + 1
    return Words(data, offsets, start, end, np.searchsorted(start, offsets), Rolling(data.astype(U) + U(1)))


def chunks(column: pa.Array, most: int = 1 << 19, inside: np.ndarray = IS_WORD, fold: np.ndarray | None = None) -> Iterator[tuple[int, int, Words]]:
    """First and last row (exclusive) and words of stretches of at most `most` bytes, or of one longer text; `fold` replaces each byte first."""
    data, offsets = texts(column)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, side="right")) - 1)
        part = data[offsets[low] : offsets[high]]
        yield low, high, split(part if fold is None else fold[part], offsets[low : high + 1] - offsets[low], inside)
        low = high


def points(data: np.ndarray) -> np.ndarray:
    """Code points before each byte, and in all at the end."""
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
