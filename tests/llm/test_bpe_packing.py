import hashlib
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sylva.llm.bpe import Encoder, body, chunk_cuts, encode_decode, repair
from sylva.llm.packing import pack, plan
from sylva.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def raw(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_encoder(library, corpus):
    e = Encoder(tokenizer_path())
    e.MOST_WORDS = 90  # forgets all the time
    texts = [t or "" for _, t, *_ in corpus] + ["'s's It'll 'S don't--'re\x1c\x85\u2028y", "ΑΣ Σ ǅ \u0130I", "a\x00b \x1fz", "é" * 50, "e\u0301\u0323 \u0301x", "<|endoftext|", "<|ENDOFTEXT|>", "ªº²¼"]
    for t in texts:
        ids = ids_of(library, t)
        assert e.encode(t.encode()) == raw(ids)
        assert e.decode(raw(ids)).decode() == library.decode(ids, skip_special_tokens=False)


def test_chunks_follow_content(corpus):
    text = corpus[-4][1] if len(corpus[-4][1] or "") > 5000 else next(t for _, t, *_ in corpus if t and len(t) > 20000)
    text = " ".join(f"{w}{i * i % 977}" for i, w in enumerate(text.split()))
    a, b = (list(chunk_cuts(pa.array([t]), 8))[0] for t in (text, "some new start " + text))
    x = {text.encode()[p:q] for p, q in zip([0, *a], a)}
    y = {("some new start " + text).encode()[p:q] for p, q in zip([0, *b], b)}
    assert a[-1] == len(text.encode()) and len(x & y) > 0.8 * len(x)


def test_repair_until_agreement(library):
    """An encoder that joins over blanks disagrees with short guards, so they grow; the result is exact all the same."""
    e = Encoder(tokenizer_path())
    text = b"aa bb cc dd ee ff gg hh ii jj kk ll mm"
    parts = [(3, 14, e.encode(text[3:14])), (18, 32, e.encode(text[18:32]))]
    assert repair(e.encode, text, parts) == e.encode(text)
    wrong = [(3, 14, e.encode(b"zz cc dd ee")), (18, 32, e.encode(b"gg hh zz jj kk"))]
    assert repair(e.encode, text, [wrong[0]]) == e.encode(text)
    assert body(b"xx yy zz ww") == (3, 8) and body(b"one two") == (0, 0) and body(b"") == (0, 0)


def test_encode_decode(docs, corpus, library):
    got = encode_decode(docs, tokenizer_path(), bits=6, with_ids=True).collect()
    expected = []
    for d, t, *_ in corpus:
        ids = ids_of(library, t)
        expected.append((d, len(ids), hashlib.sha256(raw(ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert Counter(tuple(r)[:4] for r in got) == Counter(expected)
    assert sum(r["n_chunks_reused"] for r in got) > 20


def test_repeated_rows_are_linear(spark, library):
    """Many equal rows get their chunks once each, as do rows of one text under ids of their own; and a text of some MB among them is whole."""
    rng = np.random.default_rng(3)
    text = " ".join(f"w{x}" for x in rng.integers(0, 3000, 8000))
    long = " ".join(f"w{x}" for x in rng.integers(0, 3000, 600_000))
    for ids in ([1] * 400, range(400)):
        rows = spark.createDataFrame([*((i, text) for i in ids), (1000, long)], "doc_id long, text string").repartition(8)
        got = encode_decode(rows, tokenizer_path()).groupBy("n_tokens", "ids_sha256", "n_chunks_reused").count().collect()
        expected = [ids_of(library, t) for t in (text, long)]
        assert sorted((r["n_tokens"], r["ids_sha256"]) for r in got) == sorted((len(x), hashlib.sha256(raw(x)).hexdigest()) for x in expected)
        assert sorted(r["count"] for r in got) == [1, 400]
        assert max(r["n_chunks_reused"] for r in got) <= len(long) // 100  # no chunk comes several times


def test_pack(docs, corpus, library):
    for room in (4096, 100):
        got = pack(docs, tokenizer_path(), room).collect()
        expected = Counter()
        for d, t, *_ in corpus:
            ids = [*ids_of(library, t), 1]
            expected.update((d, k // room, k, len(ids[k : k + room]), zlib.crc32(raw(ids[k : k + room]))) for k in range(0, len(ids), room))
        assert Counter(tuple(r)[:5] for r in got) == expected
        filled = defaultdict(list)
        for r in got:
            filled[r["sequence_id"]].append((r["offset"], r["length"]))
        for slots in filled.values():
            at = 0
            for offset, length in sorted(slots):
                assert offset == at
                at += length
            assert at <= room
        assert len(filled) == best_fit([x[3] for x in expected.elements()], room)


def best_fit(lengths, room):
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, x in enumerate(left) if x >= n]
        if fits:
            left[min(fits, key=left.__getitem__)] -= n
        else:
            left.append(room - n)
    return len(left)


def test_plan_is_best_fit_over_counts():
    import random

    for seed in range(60):
        rng = random.Random(seed)
        room = rng.choice([10, 64, 100])
        counts = {n: rng.randint(1, 40) for n in rng.sample(range(1, room + 1), rng.randint(1, 10))}
        slots = plan(counts, room)
        used, ranks = defaultdict(list), Counter()
        for length, low, high, first, per, at in slots:
            for rank in range(low, high + 1):
                ranks[length, rank] += 1
                used[first + (rank - low) // per].append((at + (rank - low) % per * length, length))
        assert ranks == Counter({(n, r): 1 for n in counts for r in range(counts[n])})
        for s in used.values():
            at = 0
            for offset, length in sorted(s):
                assert offset == at
                at += length
            assert at <= room
        assert len(used) == best_fit([n for n in counts for _ in range(counts[n])], room)
    assert len(plan({n: 10**9 + n for n in range(1, 4097)}, 4096)) < 200_000


def test_empty(nothing):
    assert pack(nothing, tokenizer_path()).collect() == []
    assert encode_decode(nothing, tokenizer_path()).collect() == []
