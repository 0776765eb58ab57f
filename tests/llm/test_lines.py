import hashlib
from collections import Counter

import numpy as np

from sylva.llm.lines import Cuckoo, LineDedup

PAD = " \t\n\x0b\x0c\r"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def expected(corpus, min_docs, min_chars=1):
    keyed = [[(line, lower(line.strip(PAD))) for line in (t or "").split("\n")] for _, t, *_ in corpus]
    n = Counter(k for lines in keyed for k in {k for _, k in lines if len(k) >= min_chars})
    out = []
    for (d, *_), lines in zip(corpus, keyed):
        kept = [line for line, k in lines if not (len(k) >= min_chars and n[k] >= min_docs)]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


def test_apply(spark, docs, corpus):
    for min_docs, min_chars in ((10, 1), (3, 30)):
        lines = LineDedup(spark, min_docs, min_chars, shards=7)
        got = lines.apply(lines.insert(lines.empty(), docs), docs, with_text=True)
        assert Counter(tuple(r)[:4] for r in got.collect()) == expected(corpus, min_docs, min_chars)
        assert all(hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"] for r in got.collect())


def test_shards_follow_the_keys(spark, docs, corpus):
    """More keys than the shards hold double their number; a change after that goes on with them."""
    lines = LineDedup(spark, min_docs=2, shards=1, shard_keys=4)
    half, rest = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 <> 0 or doc_id is null")
    first = lines.insert(lines.empty(), half)
    both = lines.insert(first, rest)
    assert both.shards > 1 and both.n_often == lines._often(both).count() <= 4 * both.shards
    assert Counter(map(tuple, lines.apply(both, docs).collect())) == expected(corpus, 2)
    lines = LineDedup(spark, min_docs=2, shards=1)  # its filter gets full and is made anew
    both = lines.insert(lines.insert(lines.empty(), docs.filter("doc_id < 20")), docs.filter("doc_id >= 20 or doc_id is null"))
    assert both.shards == 1 and Counter(map(tuple, lines.apply(both, docs).collect())) == expected(corpus, 2)


def test_the_log_is_merged(spark, docs, corpus, monkeypatch):
    monkeypatch.setattr("sylva.llm.lines.MOST_LOGS", 1)
    lines = LineDedup(spark, min_docs=6)
    state = lines.empty()
    for part in ("doc_id < 30", "doc_id >= 30 and doc_id < 505", "doc_id >= 505 or doc_id is null"):
        state = lines.insert(state, docs.filter(part))
    assert len(state.logs) == 1 and Counter(map(tuple, lines.apply(state, docs).collect())) == expected(corpus, 6)


def test_deletion_reverses_insertion(spark, docs, corpus):
    lines = LineDedup(spark, min_docs=6)
    half, rest = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 <> 0 or doc_id is null")
    first = lines.insert(lines.empty(), half)
    both = lines.insert(first, rest)
    back = lines.delete(both, rest)
    counts = lambda s: Counter((bytes(r["key"]), r["n_docs"]) for r in s.refs.collect())
    assert counts(back) == counts(first) != counts(both)
    assert Counter(map(tuple, lines.apply(both, docs).collect())) == expected(corpus, 6)
    assert Counter(map(tuple, lines.apply(back, half).collect())) == Counter(map(tuple, lines.apply(first, half).collect()))
    held = lambda s: {r["shard"]: sorted(np.frombuffer(r["filter"], np.uint16)[np.frombuffer(r["filter"], np.uint16) > 0]) for r in s.filters.collect()}
    assert {k: v for k, v in held(back).items() if v} == {k: v for k, v in held(first).items() if v}


def test_empty(spark, nothing):
    lines = LineDedup(spark)
    got = lines.apply(lines.insert(lines.empty(), nothing), nothing)
    assert got.collect() == [] and got.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]


def test_cuckoo():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 3000, dtype=np.uint64)
    f = Cuckoo.of(keys)
    assert f.contains(keys).all()
    f.delete(keys[:1500])
    assert f.contains(keys[1500:]).all() and f.contains(keys[:1500]).mean() < 0.01
    again = Cuckoo.from_bytes(f.to_bytes())
    assert (again.table == f.table).all()
