"""Periodic runs of words: stretches that repeat themselves at least three times over, found by internal pattern matching.

Blocks of 8, 16, 32 .. words at multiples of their length ask for their next occurrences in the window of two lengths after them: a
range successor in a wavelet matrix over the suffix array, in the range of suffixes that start with the block. A block with
a short period of its own occurs in progressions, each of which gives two candidate periods (starts matched with starts, ends with ends); other blocks occur at
most a few times in a window. Each candidate is extended both ways. A run of period q >= 8 holds a whole block of
the largest power of two up to q, and a second occurrence q words later; shorter periods show in blocks of 8.

Only words in runs of 8 words that their document repeats are looked at, since every word of a periodic run is in one.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.llm.kernels import mix, runs
from sylva.llm.shared import text_bytes

#: The shortest run, how often it must hold its period, and the words of the shortest block; the proof above counts on these three.
LEAST, TIMES, BLOCK = 24, 3, 8
#: Texts are looked at together up to so many bytes; a longer one by itself.
GROUP_BYTES = 4 << 20


class WaveletMatrix:
    """Range successors in an array of numbers from 0; packed bits, so some log2(n) * n / 5 bytes."""

    def __init__(self, values: np.ndarray):
        values, self.levels = np.asarray(values, np.int64), []
        for bit in range(max(1, int(values.max(initial=0)).bit_length()) - 1, -1, -1):
            on = (values >> bit) & 1 == 1
            packed = np.packbits(np.append(on, np.zeros(64 - len(on) % 64, bool)), bitorder="little").view(np.uint64)
            before = np.zeros(len(packed) + 1, np.int64)
            np.cumsum(np.bitwise_count(packed), out=before[1:])
            self.levels.append((bit, packed, before, len(on) - int(before[-1])))
            values = np.concatenate([values[~on], values[on]])

    @staticmethod
    def _ones(packed: np.ndarray, before: np.ndarray, i: np.ndarray) -> np.ndarray:
        part = packed[i >> 6] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return before[i >> 6] + np.bitwise_count(part)

    def successor(self, low: np.ndarray, high: np.ndarray, least: np.ndarray) -> np.ndarray:
        """For each range [low, high) of places the smallest value from `least` on, -1 without one."""
        a, b, smaller = low, high, np.zeros(len(low), np.int64)
        top = 1 << len(self.levels)
        asked = np.minimum(least, top - 1)
        for bit, packed, before, zeros in self.levels:
            one = (asked >> bit) & 1 == 1
            x, y = self._ones(packed, before, a), self._ones(packed, before, b)
            smaller += np.where(one, (b - y) - (a - x), 0)
            a, b = np.where(one, zeros + x, a - x), np.where(one, zeros + y, b - y)
        found = (smaller < high - low) & (least < top)
        a, b, k, value = low, high, np.where(found, smaller, 0), np.zeros(len(low), np.int64)
        for bit, packed, before, zeros in self.levels:
            x, y = self._ones(packed, before, a), self._ones(packed, before, b)
            off = (b - y) - (a - x)
            one = k >= off
            k, value = np.where(one, k - off, k), value | (one.astype(np.int64) << bit)
            a, b = np.where(one, zeros + x, a - x), np.where(one, zeros + y, b - y)
        return np.where(found, value, -1)


class Factors:
    """The suffix array of a sequence of numbers, by doubling, with the classes of all its factors of 1, 2, 4 .. words on the way.

    ranks[k][i]: where the suffixes that start with the 2**k words at i begin in the suffix array; sizes[k][i]: how many there are.
    """

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.n, self.ranks, self.sizes = n, [], []
        key, step = words, 1
        while True:
            order = np.argsort(key, kind="stable")
            new = np.ones(n, bool)
            new[1:] = key[order[1:]] != key[order[:-1]]
            starts = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            rank, size = np.empty(n, np.int32), np.empty(n, np.int32)
            rank[order], size[order] = starts[group], np.diff(np.append(starts, n))[group]
            self.ranks.append(rank), self.sizes.append(size)
            if len(starts) == n or step >= n:
                break
            key = rank.astype(np.int64) * (n + 1)
            key[: n - step] += rank[step:] + 1
            step *= 2
        self.suffixes = order

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j on (i < j)."""
        i, j, same = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            at = np.flatnonzero(j + (1 << k) <= self.n)
            at = at[self.ranks[k][i[at]] == self.ranks[k][j[at]]]
            for x in (i, j, same):
                x[at] += 1 << k
        return same

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i equal those before j (i < j)."""
        i, j, same = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            at = np.flatnonzero(i >= 1 << k)
            at = at[self.ranks[k][i[at] - (1 << k)] == self.ranks[k][j[at] - (1 << k)]]
            i[at] -= 1 << k
            j[at] -= 1 << k
            same[at] += 1 << k
        return same


def periodic_runs(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, length, period of all runs in a sequence of numbers, by start, then period."""
    none = np.zeros(0, np.int64)
    if len(words) < LEAST:
        return none, none, none
    f = Factors(words)
    index = WaveletMatrix(f.suffixes)
    at, by = [none], [none]

    def put(i: np.ndarray, d: np.ndarray, least: int, most: int) -> None:
        good = (d >= least) & (d < most)
        at.append(i[good]), by.append(d[good])

    for k in range(BLOCK.bit_length() - 1, len(f.ranks)):
        b = 1 << k
        least, most = 1 if b == BLOCK else b, 2 * b
        i = np.arange(0, f.n - b + 1, b)
        i = i[f.sizes[k][i] > 1]
        if not len(i):
            break  # longer blocks aren't repeated either
        low = f.ranks[k][i].astype(np.int64)
        high = low + f.sizes[k][i]
        half = f.ranks[k - 1][i].astype(np.int64)
        p = index.successor(half, half + f.sizes[k - 1][i], i + 1) - i
        own = (p > 0) & (p <= b // 2)  # the block's period, if it is at most half of it
        end = i.copy()
        end[own] = i[own] + p[own] + f.ahead(i[own], i[own] + p[own])
        own &= end >= i + b
        start = i.copy()
        start[own] -= f.behind(i[own], i[own] + p[own])
        put(i[own], p[own], least, most)
        ask = np.where(own, end - b + 1, i + 1)
        while len(i):
            s = index.successor(low, high, ask)
            near = (s >= 0) & (s - i < most)
            i, low, high, p, own, start, end, s = (x[near] for x in (i, low, high, p, own, start, end, s))
            put(i, s - i, least, most)
            last = s + p + f.ahead(s, np.minimum(s + p, f.n)) * own  # of the progression's stretch
            first = s - f.behind(s, np.minimum(s + p, f.n)) * own
            put(i[own], (last - end)[own], least, most)
            put(i[own], (first - start)[own], least, most)
            ask = np.where(own, last - b + 1, s + 1)
    at, by = np.concatenate(at), np.concatenate(by)
    good = at + by < f.n
    at, by = at[good], by[good]
    first, last = at - f.behind(at, at + by), at + by + f.ahead(at, at + by)
    good = last - first >= np.maximum(LEAST, TIMES * by)
    first, last, by = first[good], last[good], by[good]
    order = np.lexsort((by, last, first))
    first, last, by = first[order], last[order], by[order]
    new = np.ones(len(first), bool)  # of equal stretches, the least period is their smallest
    new[1:] = (first[1:] != first[:-1]) | (last[1:] != last[:-1])
    first, last, by = first[new], last[new], by[new]
    order = np.lexsort((by, first))
    return first[order], (last - first)[order], by[order]


def _repeated(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which words of the documents (bounds: where each begins, and the end) lie in BLOCK words that occur twice in their document; a few more may be marked."""
    out, n = np.zeros(len(words) + 1, np.int64), len(words) - BLOCK + 1
    if n <= 0:
        return out[:-1] > 0
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    inside = np.flatnonzero(doc[:n] == doc[BLOCK - 1 :])
    hashes = (runs(mix(words.astype(np.uint64)), BLOCK) ^ mix(doc[:n].astype(np.uint64) + np.uint64(1)))[inside]
    order = np.argsort(hashes)
    same = hashes[order[1:]] == hashes[order[:-1]]
    twice = inside[np.unique(np.concatenate([order[1:][same], order[:-1][same]]))]
    np.add.at(out, twice, 1)
    np.add.at(out, twice + BLOCK, -1)
    return np.cumsum(out)[:-1] > 0


def runs_of_documents(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start (among all words), length, period of the runs of several documents. Equal numbers are equal words."""
    places = np.flatnonzero(_repeated(words, bounds))
    if not len(places):
        return places, places, places
    # Stretches of marked words, each followed by a number of its own; documents hold different numbers.
    doc = np.searchsorted(bounds, places, "right")
    gap = np.flatnonzero((np.diff(places) > 1) | (np.diff(doc) > 0)) + 1
    _, small = np.unique(words[places] * np.int64(len(bounds)) + doc, return_inverse=True)
    given = np.insert(small, gap, len(places) + np.arange(len(gap)))
    where = np.insert(places, gap, -1)
    start, length, period = periodic_runs(given)
    return where[start], length, period


Fold = Callable[[int | None, int], np.ndarray | None]


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which of its n words stands at each place of a document: every tenth repeats words from some place on. Null doc_id: as they are."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i >= a, a + (i - a) % p, i)


def _best(start: np.ndarray, length: np.ndarray, period: np.ndarray) -> int:
    ratio = length / period
    near = np.flatnonzero(ratio >= ratio.max() * (1 - 1e-9)).tolist()
    return min(near, key=lambda i: (-Fraction(int(length[i]), int(period[i])), start[i], period[i]))


_FIELDS = [(c, pa.int64()) for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli")] + [("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]
_RUNS = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))


def _scan(fold: Fold | None, detail: bool):
    schema = pa.schema(_FIELDS + [("runs", _RUNS), ("text", pa.string())] * detail)

    def group(ids: list, texts: list[bytes]) -> pa.RecordBatch:
        numbers, next_number, each, values = {}, count(), [], []
        for doc_id, text in zip(ids, texts):
            words = text.split()
            order = fold(doc_id, len(words)) if fold else None
            own = np.fromiter(map(numbers.setdefault, words, next_number), np.int64, len(words))
            if order is not None:
                words, own = list(map(words.__getitem__, order.tolist())), own[order]
            each.append(words), values.append(own)
        bounds = np.cumsum([0, *map(len, values)])
        start, length, period = runs_of_documents(np.concatenate(values), bounds)
        first, out = np.searchsorted(start, bounds), []
        for i, (doc_id, words) in enumerate(zip(ids, each)):
            s, n, q = (x[first[i] : first[i + 1]] for x in (start, length, period))
            s = s - bounds[i]
            row, listed = (len(s), None, None, None, None), b""
            if len(s):
                best = _best(s, n, q)
                row = (len(s), *(int(x[best]) for x in (s, n, q)), 1000 * int(n[best]) // int(q[best]))
                listed = "".join(f"{x},{y},{z}\n" for x, y, z in zip(s.tolist(), n.tolist(), q.tolist())).encode()
                gone = np.zeros(len(words) + 1, np.int64)
                np.add.at(gone, s + q, 1)
                np.add.at(gone, s + n, -1)
                words = [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g]
            left = b" ".join(words)
            made = (doc_id, *row, hashlib.sha256(listed).hexdigest(), hashlib.sha256(left).hexdigest())
            out.append((*made, [dict(zip(("start", "length", "period"), x)) for x in zip(s.tolist(), n.tolist(), q.tolist())], left.decode()) if detail else made)
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, size = [], [], 0
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                for doc_id, text in zip(part["doc_id"].to_pylist(), text_bytes(part["text"])):
                    if ids and size + len(text) > GROUP_BYTES:
                        yield group(ids, texts)
                        ids, texts, size = [], [], 0
                    ids.append(doc_id), texts.append(text)
                    size += len(text)
            if ids:
                yield group(ids, texts)

    return rows


def find_runs(docs: DataFrame, fold: Fold | None = None, detail: bool = False) -> DataFrame:
    """doc_id, n_runs; start, length, period, exponent_milli of the run with the greatest length / period (ties: smallest start, then period), null
    without runs; runs_sha256, collapsed_sha256, for every row of docs (doc_id, text). detail: also all runs, and the text that is left.

    A run is a stretch of at least max(24, 3 * period) words in which words one period apart are the same, that can't be made longer, with its smallest
    period. Words that any run holds after its first period go. Words are compared as they stand. fold: which word of the text
    stands at each place, for documents to be judged in another order.

    Null and empty texts have no words and no runs. Rows are judged each by itself, so a null or repeated doc_id changes nothing; other columns are
    left. Nothing is shuffled; a text is scanned within one task, which takes some 100 bytes for each word in repeated passages.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    out = ", ".join(f"{c} {'string' if t == pa.string() else 'long'}" for c, t in _FIELDS)
    return given.mapInArrow(_scan(fold, detail), out + ", runs array<struct<start long, length long, period long>>, text string" * detail)
