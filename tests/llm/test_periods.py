"""Periodic runs against brute force: every period of every stretch."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from sylva.llm.periods import Factors, WaveletMatrix, find_runs, periodic_runs, planted, runs_of_documents

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(words):
    """All runs: for each period the longest stretches that keep it; of equal stretches only the smallest period."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i:
                if j + q - i >= max(24, 3 * q):
                    found.setdefault((i, j + q - i), q)
                i = j
            else:
                i += 1
    return sorted((s, length, q) for (s, length), q in found.items())


def expected(doc_id, text, fold):
    w = WORD.findall(text or "")
    if fold and doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(len(w))]
    found = brute(w)
    gone = {j for s, n, q in found for j in range(s + q, s + n)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    listed, left = "".join(f"{s},{n},{q}\n" for s, n, q in found), " ".join(x for j, x in enumerate(w) if j not in gone)
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *(hashlib.sha256(x.encode()).hexdigest() for x in (listed, left)))


def sequences():
    rng = random.Random(7)
    out = [[0] * n for n in (0, 1, 23, 24, 25, 100)]
    for seed in range(300):
        rng.seed(seed)
        letters, made = rng.choice([2, 2, 3, 30]), []
        while len(made) < rng.choice([40, 150, 400]):
            unit = [rng.randrange(letters) for _ in range(rng.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 40]))]
            if rng.random() < 0.4:  # units with short periods of their own
                unit = unit[: 1 + rng.randrange(3)] * rng.randint(2, 12) + unit
            made += (unit * rng.randint(1, 5))[: rng.randint(1, 200)]
            made += [rng.randrange(letters) for _ in range(rng.randrange(3))]
        out.append(made)
    a, b = [0], [0, 1]
    for _ in range(12):
        a, b = b, b + a  # Fibonacci words have the most runs
    return [*out, b[:600], [bin(i).count("1") % 2 for i in range(500)]]


def test_runs():
    n = 0
    for words in sequences():
        got = list(zip(*(x.tolist() for x in periodic_runs(np.array(words, np.int64)))))
        assert got == brute(words), words
        n += len(got)
    assert n > 500


def test_documents_together():
    docs = [w for w in sequences() if len(w) > 30][:40]
    bounds = np.cumsum([0, *map(len, docs)])
    got = list(zip(*(x.tolist() for x in runs_of_documents(np.concatenate([np.array(w, np.int64) for w in docs]), bounds))))
    assert got == [(s + b, n, q) for w, b in zip(docs, bounds.tolist()) for s, n, q in brute(w)]


def test_wavelet_matrix():
    rng = np.random.default_rng(3)
    for n in (1, 2, 63, 64, 65, 500):
        values = rng.permutation(n)
        low = rng.integers(0, n, 200)
        high = np.minimum(n, low + rng.integers(0, n + 1, 200))
        least = rng.integers(0, n + 2, 200)
        want = [min((v for v in values[a:b].tolist() if v >= x), default=-1) for a, b, x in zip(low, high, least)]
        assert WaveletMatrix(values).successor(low, high, least).tolist() == want


def test_factors():
    words = np.array(([0, 1, 0, 0, 1, 2] * 9)[:50])
    f = Factors(words)
    text = words.tolist()
    assert f.suffixes.tolist() == sorted(range(50), key=lambda i: text[i:])
    i, j = np.array([0, 0, 3, 10]), np.array([6, 1, 9, 12])
    assert f.ahead(i, j).tolist() == [44, 0, 41, 0]
    assert f.behind(i, j).tolist() == [0, 0, 3, 0]


@pytest.mark.parametrize("fold", [None, planted])
def test_find_runs(spark, docs, corpus, fold):
    lines = "one line that is said again and again\n" * 9
    more = [(9000, lines + "and another " * 20 + lines), (9001, "x " * 23), (9002, "x " * 24), (9003, "a b c d e f g h i j k l " * 3), (9004, "x   x   " * 30), (None, "y\tz\n" * 40)]
    more += [(10_000 + i, " ".join(f"w{j * i % 71}" for j in range(40 * i))) for i in range(40)]
    given = [r[:2] for r in corpus if len(r[1] or "") < 20_000] + more
    frame = spark.createDataFrame([(*r, 1, "s") for r in given], "doc_id long, text string, start long, period string")
    want = Counter(expected(*r, fold) for r in given)
    assert Counter(map(tuple, find_runs(frame, fold).collect())) == want and sum(r[1] > 0 for r in want) > 20


def test_detail_and_long_text(spark):
    base = " ".join(f"u{i}" for i in range(300_000))
    rows = spark.createDataFrame([(1, base + " p q r s" * 100_000), (2, "k " * 30)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in find_runs(rows, detail=True).collect()}
    assert [tuple(x) for x in got[1]["runs"]] == [(300_000, 400_000, 4)] and got[1]["text"] == base + " p q r s" and got[2]["text"] == "k"


def test_empty(nothing):
    assert find_runs(nothing, planted).collect() == []
