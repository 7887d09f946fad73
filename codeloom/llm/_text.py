"""Words and rolling hashes over the flat bytes of an Arrow string column.

Everything here works on whole Arrow batches: a string column is one byte buffer and one offset
array, so splitting, hashing and windowing are a few numpy passes, with no Python object per word.
A batch is cut into pieces of about PIECE bytes (never inside a text), so memory follows the piece,
or the longest single text, and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer single text is a piece of its own.
PIECE = 250_000

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64, endpoint=False)
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: Bytes that can be part of a word: all but white space; all but ASCII other than letters and digits.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The finalizer of SplitMix64, a bijection on 64 bits; seed picks another one."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2**64, and their inverses."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for b in (int(_BASES[base]), pow(int(_BASES[base]), -1, 2**64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        have = _powers[base] = (out[0], out[1])
    return have[0][:n], have[1][:n]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, one after the other, and where each row begins; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array, size: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows of about `size` bytes."""
    data, offsets = flat(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


class Words:
    """The words of a piece: byte spans, the word index where each row begins, and 64-bit hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = NOT_SPACE, lower: bool = False):
        if lower:
            data = LOWER[data]
        self.data, self.offsets = data, offsets
        n = len(data)
        inside = kind[data]
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        before = np.concatenate(([False], inside[:-1])) if n else inside
        after = np.concatenate((inside[1:], [False])) if n else inside
        self.starts = np.flatnonzero(inside & (~before | cut[:n]))
        self.ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
        self.rows = np.searchsorted(self.starts, offsets)
        self._hashes: np.ndarray | None = None

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            p, inverse = powers(0, len(self.data) + 1)
            sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_BYTE[self.data] * p[:-1], out=sums[1:])
            h = (sums[self.ends] - sums[self.starts]) * inverse[self.starts]
            self._hashes = mix(h + (self.ends - self.starts).astype(np.uint64))
        return self._hashes

    def counts(self) -> np.ndarray:
        return np.diff(self.rows)

    def row_of(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts())

    def windows(self, length: int, which: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every run of `length` words inside one row; `which` (1 or 2) picks one of two independent hash functions."""
        n = len(self.starts)
        if n < length:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        p, inverse = powers(which, n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.hashes if which == 1 else mix(self.hashes, 77)) * p[:-1], out=sums[1:])
        first = np.arange(n - length + 1)
        left = np.repeat(self.rows[1:], self.counts())[: len(first)]  # the word index where the row ends
        first = first[first + length <= left]
        return first, mix((sums[first + length] - sums[first]) * inverse[first], which)

    def text(self, i: int, j: int) -> bytes:
        """Words i to j - 1, joined by one space."""
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.starts[i:j], self.ends[i:j], strict=True))


def covered(first: np.ndarray, length: int, n: int) -> np.ndarray:
    """Of n words, which lie in a window of `length` words that begins at one of `first`."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, first, 1)
    np.add.at(step, np.minimum(first + length, n), -1)
    return np.cumsum(step[:n]) > 0
