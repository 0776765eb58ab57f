"""Array kernels over the UTF-8 bytes of a batch of texts: words, word hashes and hashes of runs of words.

They work on the contiguous value buffer of an Arrow column, a bounded slice at a time, so a task's memory
follows the slice (or the longest single text), not its partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 1 << 20
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_Q = np.uint64(0xC2B2AE3D27D4EB4F)
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_BLANK = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])
#: The first n bytes of eight, for n from 0 to 8.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Words of more bytes than this are hashed one by one.
LONG_WORD = 256
_powers = {True: np.ones(1, np.uint64), False: np.ones(1, np.uint64)}


def _power(n: int, inverse: bool) -> np.ndarray:
    """P**0 .. P**(n-1), or of P's inverse, modulo 2**64."""
    have = _powers[inverse]
    if len(have) < n:
        base = _P_INVERSE if inverse else _P
        more = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        more[0] = 1
        have = _powers[inverse] = np.multiply.accumulate(more)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread each 64-bit value over all bits (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row of the first text, the bytes, start of each text and the end) for runs of whole texts of bounded size."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


class Words:
    """The words of a slice. start, end: byte positions; first: for each text its first word, and the number of words at last."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        n = len(data)
        inside = ~_BLANK[data]
        edge = np.zeros(n + 1, bool)
        edge[bounds] = True
        opens, closes = inside.copy(), inside.copy()
        if n:
            opens[1:] &= ~inside[:-1] | edge[1:n]
            closes[:-1] &= ~inside[1:] | edge[1:n]
        self.data, self.bounds = data, bounds
        self.start, self.end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, bounds)

    def hashes(self, lower: bool = False, salt: int = 0) -> np.ndarray:
        """A 64-bit hash of each word; lower: A-Z count as a-z. Two salts give two independent hashes.

        Eight bytes at a time are put through a bijection, so no two words of up to eight bytes share a hash, and longer ones
        none that their letters could bring about by an algebraic pattern.
        """
        n = len(self.data)
        padded = np.zeros(n + 8, np.uint8)
        padded[:n] = _LOWER[self.data] if lower else self.data
        eight = np.ndarray((n + 1,), "<u8", padded, 0, (1,))
        size = self.end - self.start
        out = mix((size + (salt << 32)).astype(np.uint64) * _P)
        out = mix(out ^ (eight[self.start] & _FIRST[np.minimum(size, 8)]))
        more, at = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
        while len(more):
            out[more] = mix(out[more] ^ (eight[self.start[more] + at] & _FIRST[np.minimum(size[more] - at, 8)]))
            at += 8
            more = more[size[more] > at]
        for i in np.flatnonzero(size > LONG_WORD).tolist():
            out[i] = xxhash.xxh3_64_intdigest(padded[self.start[i] : self.end[i]].tobytes(), salt)
        return out


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * _Q + right)


def runs(words: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of each run of so many consecutive words (by their hashes), from hashes of runs of 1, 2, 4 .. words."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, have, part, size, rest = None, 0, mix(words + _P), 1, length
    while rest:
        if rest & 1:
            out = part if out is None else _joined(out[: len(words) - have - size + 1], part[have:])
            have += size
        rest >>= 1
        if rest:
            part = _joined(part[:-size], part[size:])
            size *= 2
    return out
