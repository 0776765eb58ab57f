import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from sylva.llm.near import least_matches, near_duplicates, survives
from sylva.llm.substrings import levels, remove_repeats, window_minima

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(text or "")]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(corpus, percent):
    sets = [(d, shingles(t)) for d, t, *_ in corpus]
    up = {d: d for d, _ in sets if d is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if None not in (a, b) and x and y and 100 * len(x & y) >= percent * len(x | y):
                a_, b_ = sorted((root(a), root(b)))
                up[b_] = a_
    return Counter((d, len(x), None if d is None else root(d), d is None or root(d) == d) for d, x in sets)


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates(docs, corpus, percent):
    got = near_duplicates(docs, percent).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert Counter(map(tuple, got)) == components(corpus, percent)


def test_each_text_of_a_repeated_id_has_its_links(spark):
    """Links through any text of an id count, whichever row comes first; its rows, also those without words, have one component."""
    say = lambda k: [f"{k}w{i}" for i in range(150)]
    near = lambda k: " ".join([*say(k)[:149], "x"])
    rows = []
    for i in range(0, 400, 40):  # i+9 has a near copy of each of its texts; i+20 links i+8 and i+21, and has a text without words
        rows += [(i + 9, " ".join(say(f"{i}{k}"))) for k in "abc"]
        rows += [(i + 10 + j, near(f"{i}{k}")) for j, k in enumerate("abc")]
        rows += [(i + 20, near(f"{i}d")), (i + 20, ""), (i + 20, " ".join(say(f"{i}e"))), (i + 8, " ".join(say(f"{i}d"))), (i + 21, near(f"{i}e"))]
        rows += [(i + 30, " ".join(say(f"{i}f"))), (i + 31, None), (i + 31, " ".join(say(f"{i}f")))]
    rows += [(None, rows[0][1]), (None, ""), (1, "")]
    for order in (rows, rows[::-1]):
        got = near_duplicates(spark.createDataFrame(order, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id", "kept").collect()
        assert Counter(map(tuple, got)) == components(rows, 85)


def test_a_bucket_whose_members_chain(spark):
    """Neighbours are linked, far members aren't: the star about one member can't find all links."""
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(words[3 * i : 3 * i + 120])) for i in range(50)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert Counter(map(tuple, got)) == components(rows, 85)


def test_a_common_frame_joins_nothing(spark):
    """Texts that share most of their words with many others, but are linked with none, fall into buckets together and are not compared."""
    from pyspark.sql import functions as F

    from sylva.llm.near import _sets, rare_edges
    from sylva.llm.shared import Tables

    frame = [f"f{i}" for i in range(120)]
    rows = [(i, " ".join([*frame, *(f"w{i}x{j}" for j in range(50))])) for i in range(600)]
    rows += [(1000 + i, " ".join([*frame, *(f"w{i}x{j}" for j in range(47)), "a", "b", "c"])) for i in range(0, 600, 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates(docs).select("doc_id", "component_id").collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {d: d % 1000 for d, _ in rows}
    sets = docs.select(F.col("doc_id").alias("node"), "text").mapInArrow(_sets, "node long, set binary")
    edges = rare_edges(sets, docs.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("c")), 85, Tables(spark, "test"))
    assert {tuple(sorted(r)) for r in edges.collect()} == {(i, 1000 + i) for i in range(0, 600, 100)}


def test_bounds():
    bounds = least_matches(0.85, 1e-9, 16, 128)
    assert bounds == sorted(bounds) and 0 < bounds[0] < 16 and bounds[-1] < 128
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 32, (2000, 128), dtype=np.uint32)
    b = np.where(rng.random((2000, 128)) < 0.85, a, a + 1)
    assert survives(a, b, 0.85, 1e-9).all()
    b = np.where(rng.random((2000, 128)) < 0.3, a, a + 1)
    assert survives(a, b, 0.85, 1e-9).mean() < 0.01


def test_near_empty(nothing):
    assert near_duplicates(nothing).collect() == []


def removed(corpus, length):
    texts = [(-(1 << 63) if d is None else d, WORD.findall(t or "")) for d, t, *_ in corpus]
    first = {}
    for d, w in texts:
        for i in range(len(w) - length + 1):
            s = tuple(w[i : i + length])
            first[s] = min(first.get(s, d), d)
    out = []
    for (d, *_), (k, w) in zip(corpus, texts):
        gone = set()
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < k:
                gone.update(range(i, i + length))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("length,seed", [(13, 7), (50, 7), (13, 3), (5, 5), (20, 19)])
def test_remove_repeats(docs, corpus, length, seed):
    got = remove_repeats(docs, length, seed, with_text=True).collect()
    assert Counter(tuple(r)[:4] for r in got) == removed(corpus, length)
    by_text = {(d, t) for d, t, *_ in corpus}
    for r in got:
        assert hashlib.sha256(" ".join(WORD.findall(r["text"])).encode()).hexdigest() == r["kept_sha256"]
        assert r["n_removed"] or (r["doc_id"], r["text"]) in by_text or (r["doc_id"], None) in by_text


def test_windows():
    assert levels(7, 13) == [7, 13] and levels(7, 50) == [7, 14, 28, 50] and levels(5, 5) == [5]
    x = np.random.default_rng(2).integers(0, 9, 100)
    for size in (1, 2, 5, 7, 44):
        assert list(window_minima(x, size)) == [i + int(np.argmin(x[i : i + size])) for i in range(100 - size + 1)]


def test_repeats_empty(nothing):
    assert remove_repeats(nothing).collect() == []


def test_a_large_cluster(spark, monkeypatch):
    """Hundreds of near copies at all distances from their origin, in many blocks: every link that joins components is found."""
    import random

    rng = random.Random(11)
    origin = [f"w{i}" for i in range(120)]
    rows = [(0, " ".join(origin))]
    for i in range(1, 260):
        w = list(origin)
        for _ in range(rng.randint(0, 7)):
            k = rng.randrange(120)
            w[k] = f"x{k}" if rng.random() < 0.5 else f"y{rng.randrange(99)}"
        rows.append((i, " ".join(w)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert Counter(map(tuple, got)) == components(rows, 85)


def test_intersections():
    from sylva.llm.near import intersections

    rng = np.random.default_rng(8)
    a, b = ([np.unique(rng.integers(0, 9000, rng.integers(1, 6000), dtype=np.uint64)) for _ in range(n)] for n in (5, 7))
    assert intersections(a, b).tolist() == [[len(set(x.tolist()) & set(y.tolist())) for y in b] for x in a]


def test_components(spark):
    import random

    from sylva.llm.graph import components
    from sylva.llm.shared import Tables

    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(45)] + [(300, 301 + i) for i in range(30)] + [(7, 7), (40, 39)]
    up = {}
    for a, b in edges:
        up.setdefault(a, a), up.setdefault(b, b)
    for _ in range(100):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    got = components(spark.createDataFrame(edges, "a long, b long"), Tables(spark, "test")).collect()
    assert {r["node"]: r["component"] for r in got} == {a: b for a, b in up.items() if a != b} and len(got) == len({r["node"] for r in got})
    assert components(spark.createDataFrame([], "a long, b long"), Tables(spark, "test")).collect() == []
