"""Byte and word arrays over batches of texts (numpy helpers used inside tasks).

A batch of texts is one array of UTF-8 bytes and the offsets of the texts in it. Hashes are
polynomials modulo 2**64 read off prefix sums, so that any stretch costs one subtraction.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Odd multipliers of the polynomials, and their inverses modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown per worker."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        steps = np.full(max(n, 1 << 16), base, U)
        steps[0] = 1
        known = _POWERS[base] = np.cumprod(steps, dtype=U)
    return known[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def as_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of an Arrow column, and where each text starts (nulls: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    blob = pc.fill_null(column.cast(pa.large_binary()), b"")
    at = np.frombuffer(blob.buffers()[1], np.int64)[blob.offset : blob.offset + len(blob) + 1]
    data = np.frombuffer(blob.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    return data, at - at[0]


def prefix_hash(values: np.ndarray, base: int) -> np.ndarray:
    """P with P[j] - P[i] = sum of values[k] * base**-k over i <= k < j."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values.astype(U) * powers(inverse(base), len(values)), dtype=U, out=out[1:])
    return out


def stretch_hash(prefix: np.ndarray, begin: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """The polynomial of each stretch, the same wherever it lies."""
    return (prefix[end] - prefix[begin]) * powers(base, len(prefix))[begin]


class Words:
    """The maximal runs of non-space bytes of each text: begin, end, the text each lies in, a hash."""

    def __init__(self, data: np.ndarray, at: np.ndarray, lower: bool = False, cuts=None):
        """``cuts``: bytes -> where a word begins although no space is before it."""
        self.data, self.at = (LOWER[data] if lower else data), at
        solid = ~SPACE[self.data]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        edge = at[:-1][np.diff(at) > 0]
        first[edge] = solid[edge]
        if cuts is not None:
            first |= solid & cuts(self.data)
        last = solid.copy()
        last[:-1] &= ~solid[1:] | first[1:]
        self.begin, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.per_text = np.diff(np.searchsorted(self.begin, at))
        self.first = np.concatenate(([0], np.cumsum(self.per_text)))
        self.text = np.repeat(np.arange(len(at) - 1), self.per_text)
        self._hash: dict[int, np.ndarray] = {}

    def __len__(self) -> int:
        return len(self.begin)

    def hash(self, lane: int = 0) -> np.ndarray:
        if lane not in self._hash:
            base = BASES[lane]
            h = np.zeros(len(self), U)
            for i, j in runs(np.append(self.begin, len(self.data)), 1 << 20):
                lo, hi = self.begin[i], self.end[j - 1]
                prefix = prefix_hash(self.data[lo:hi], base)
                h[i:j] = stretch_hash(prefix, self.begin[i:j] - lo, self.end[i:j] - lo, base)
            self._hash[lane] = mixed(h + (self.end - self.begin).astype(U) * U(0xA0761D6478BD642F))
        return self._hash[lane]

    def windows(self, n: int) -> np.ndarray:
        """Numbers of the words at which n consecutive words of one text start."""
        left = self.first[1:][self.text] - np.arange(len(self))
        return np.flatnonzero(left >= n)

    def window_hash(self, starts: np.ndarray, n: int, lane: int = 0) -> np.ndarray:
        base = BASES[lane]
        return mixed(stretch_hash(prefix_hash(self.hash(lane), base), starts, starts + n, base))


def runs(texts: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Texts (by their offsets) in consecutive runs of at most ``most`` bytes, or of one text."""
    out, i, n = [], 0, len(texts) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(texts, texts[i] + most, side="right")) - 1)
        out.append((i, min(j, n)))
        i = out[-1][1]
    return out
