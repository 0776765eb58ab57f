"""Decontamination against brute force: exact windows of words, and proximity by distances from the rarest word."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pytest

from sylva.llm.decontamination import decontaminate, near_items

SPLIT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[str]:
    return SPLIT.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def windows_of(items: list[tuple], length: int) -> dict[tuple, set]:
    out: dict[tuple, set] = {}
    for item, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - length + 1) if w else 0):
            out.setdefault(tuple(w[i : i + length]), set()).add(item)
    return out


def brute(docs: list[tuple], items: list[tuple], length: int) -> list[tuple]:
    of, out = windows_of(items, length), []
    for doc_id, text in docs:
        w, hit, found = words_of(text), set(), set()
        for n in {len(x) for x in of}:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in of:
                    hit.update(range(i, i + n))
                    found |= {str(k) for k in of[x] if k is not None}
        ids = sorted(found, key=str.encode)
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


def near_brute(docs: list[tuple], items: list[tuple], length: int, slop: int) -> set[tuple]:
    texts = [(d, words_of(t)) for d, t in docs]
    df = Counter(w for _, t in texts for w in t)
    out: dict[tuple, list[int]] = {}
    for at, (_, text) in enumerate(texts):
        for window, held in windows_of(items, length).items():
            rare = min(range(len(window)), key=lambda i: (df[window[i]], window[i].encode(), i))
            for p, word in enumerate(text):
                if word == window[rare]:
                    far = [min((abs(q - (p + i - rare)) for q, v in enumerate(text) if v == w and abs(q - (p + i - rare)) <= slop), default=None) for i, w in enumerate(window) if i != rare]
                    if None not in far:
                        for item in held:
                            out.setdefault((at, item), []).append(sum(far))
    return {(docs[at][0], str(item), len(x), min(x)) for (at, item), x in out.items() if item is not None}


ITEM = "The quick brown fox, jumps over 13 lazy dogs and 7 café cats While it rains in Łódź"
ITEMS = [
    (1, ITEM), (10, ITEM), (2, "Eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf"), (3, "only four words here"), (4, None), (5, ""), (6, "..."), (7, "Unik"), (None, "an item without id is found as well"),
    (8, "red red red red red red red red red red red red"), (1, "a second text of the first item with more than ten words in it"),
]
DOCS = [
    (1, f"Before. {ITEM.upper().replace('É', 'é').replace('Ł', 'Ł')} after"), (2, "x " + ITEM[:60] + " y"), (3, None), (4, ""), (5, "?!"), (6, "here ONLY,four;words-here only four words"), (None, "unik Unik UNIK"), (None, f"{ITEM} {ITEM}"),
    (8, "red " * 25), (8, "an item without id is found as well."), (9, "eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf " * 3), (11, "the quick brown the fox jumps over 13 lazy dogs and and 7 café cats while it rains"), (12, "eins ZWEI drei vier fünf sechs sieben acht neun ten elf"),
    (13, "filler words " * 400_000 + ITEM), (-(2**63), "unik"),
]


def _given(spark, docs=DOCS, items=ITEMS):
    d = spark.createDataFrame([(*x, "clash", 1) for x in docs], "doc_id long, text string, term string, n long")
    return d, spark.createDataFrame([(*x, 0) for x in items], "item_id long, text string, doc long")


def test_exact(spark):
    docs, items = _given(spark)
    got = decontaminate(docs, items)
    assert Counter(map(tuple, got.drop("items").collect())) == Counter(brute(DOCS, ITEMS, 10))
    assert all(r["n_items"] == len(r["items"]) for r in got.collect())


def test_corpus(spark, docs, corpus):
    """Passages of the corpus itself as items, some of them in many documents."""
    long = [r[1] for r in corpus if r[1] and len(r[1].split()) > 30]
    items = [(i, " ".join(t.split()[3 : 3 + 5 * (i % 8) + 2])) for i, t in enumerate(long[:60])]
    got = decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"), 6).drop("items").collect()
    assert Counter(map(tuple, got)) == Counter(brute([r[:2] for r in corpus], items, 6))


@pytest.mark.parametrize("slop", [0, 1, 2])
def test_proximity(spark, slop):
    docs = [d for d in DOCS if len(d[1] or "") < 10_000]
    d, i = _given(spark, docs)
    assert {tuple(r) for r in near_items(d, i, slop=slop).collect()} == near_brute(docs, ITEMS, 10, slop)


def test_empty(spark):
    docs, items = _given(spark)
    assert decontaminate(docs.limit(0), items).count() == 0
    assert decontaminate(docs, items.limit(0)).filter("contaminated or n_items > 0").count() == 0
    assert near_items(docs, items.limit(0)).count() == 0
