"""Collocations against brute force, and the counting of cells."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from sylva.llm import collocations as c


def brute(rows, least, longest, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + m]) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    frequent = {k: v for k, v in f.items() if v >= least and len(k) > 2}
    inside = {}
    for (lang, *w), v in frequent.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                k = (lang, *w[i : i + m])
                inside[k] = max(inside.get(k, 0), v)
    out = []
    for (lang, *w), a in frequent.items():
        if inside.get((lang, *w), -1) < a:
            cuts = [(1000 * a * n[lang] // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            out.append((lang, -score, -a, " ".join(w).encode(), f[lang, *w[:k]], f[lang, *w[k:]]))
    ranked, seen = [], Counter()
    for lang, score, a, phrase, left, right in sorted(out):
        seen[lang] += 1
        if seen[lang] <= top:
            ranked.append((lang, seen[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return ranked


def texts():
    rng = random.Random(11)
    vocabulary = [rng.choice("abcdeéßŁ") + str(i) for i in range(60)] + ["the", "THE", "İx", "-", " ", "x y"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    said = [" ".join(rng.choices(vocabulary, weights, k=rng.randint(2, 6))) for _ in range(30)]
    out = []
    for i in range(400):
        parts = [rng.choice(said) if rng.random() < 0.5 else " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 9))) for _ in range(rng.randint(0, 12))]
        out.append((rng.choice([" ", ". ", ",", "\n", "\r\n", "\t", " ; ", "\x0b"]).join(parts), rng.choice(["en", "en", "en", "de", None, ""])))
    return [*out, (None, "en"), ("", "de"), ("...", "fr"), ("only once", "fr"), ("no " * 3000, "en"), ("und too " * 40, "und"), *[("Same row, same row", "en")] * 7]


@pytest.mark.parametrize("least,longest,top", [(5, 5, 2000), (3, 5, 20), (20, 2, 50), (1, 3, 100000)])
def test_brute(spark, monkeypatch, least, longest, top):
    monkeypatch.setattr(c, "ENTRIES", 500)
    rows = texts()
    docs = spark.createDataFrame([(*r, i, 1) for i, r in enumerate(rows)], "text string, lang string, n long, unit long").repartition(6)
    got = sorted(tuple(r) for r in c.collocations(docs, least, longest, top).collect())
    assert got == sorted(brute(rows, least, longest, top)) and got


def test_long_text(spark):
    """More words in one text than a unit has."""
    rows = [(" ".join(f"w{(i * i) % 997 % (50 + i % 3)}" for i in range(600_000)) + " over and out" * 150, "en")]
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert [tuple(r) for r in c.collocations(docs, 100, 3, 40).orderBy("rank").collect()] == brute(rows, 100, 3, 40)


@pytest.mark.parametrize("times", [0, 10, 1 << 21])
def test_counting(times):
    rng, deal = np.random.default_rng(5), c.Deal(times * c.ENTRIES)
    assert deal.cells * deal.stripes == c.SIDE**2
    left, right = rng.integers(0, c.SIDE, 200_000), rng.integers(3 * c.SIDE, 4 * c.SIDE, 200_000)
    for some in (50, len(left)):  # by sorting, and by bincount
        codes = (left << 32 | right)[:some]
        parts, got = deal.part(codes), {}
        assert set((parts // deal.stripes).tolist()) == {3}
        for part in np.unique(parts).tolist()[:500]:
            own = codes[parts == part]
            cells, sums = deal.add_up(own, np.full(len(own), 3), part)
            assert dict(zip(cells.tolist(), sums.tolist())) == {k: 3 * v for k, v in Counter(own.tolist()).items()} and (np.diff(cells) > 0).all()
    sparse = deal.part(np.arange(5000, 9000) << 32) - deal.head
    assert sparse.min() >= 0 and (set(sparse.tolist()) == set(range(4 + times)) or times > 100)
    assert c.unpacked(c.packed(codes)).tolist() == codes.tolist() and c.unpacked(c.packed(codes[:0])).tolist() == []


def test_exact_scores(spark):
    from pyspark.sql import functions as F

    big = [(10**17, 10**17, 10**14, 10**15 + 7), (99_999_999_999_999_999, 10**16 + 3, 10**15 + 1, 10**15 + 9), (100, 241758, 100, 100), (10**17, 10**17, 10**17, 10**17)]
    got = spark.createDataFrame(big, "a long, n long, l long, r long").select(c.cut_score(*map(F.col, "anlr"))).collect()
    assert [r[0] for r in got] == [1000 * a * n // (x * y) for a, n, x, y in big]


def test_empty(nothing):
    assert c.collocations(nothing).collect() == []
