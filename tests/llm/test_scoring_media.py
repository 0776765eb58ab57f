import hashlib
import io
import math
import random
import re
import struct
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from sylva.llm.media import area_sums, decode, difference_hash, encode_pgm, resize, text_media, tiles
from sylva.llm.queries import op10_media
from sylva.llm.scoring import UNIT, score

WORD = re.compile("[^\x20\x09-\x0d]+")


def scores(corpus, order):
    texts = [(d, WORD.findall(t or "")) for d, t, *_ in corpus]
    grams = lambda w: Counter(tuple(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1))
    n, total = Counter(), sum(len(w) for _, w in texts)
    for _, w in texts:
        n.update(grams(w))
    out = []
    for d, w in texts:
        own, s, words = grams(w), 0.0, total - len(w)
        for i in range(len(w)):
            allowed = min(order, i + 1)
            rest = [n[g] - own[g] for g in (tuple(w[i - k + 1 : i + 1]) for k in range(1, allowed + 1))]
            k = max((k for k in range(1, allowed + 1) if rest[k - 1]), default=0)
            context = tuple(w[i - k + 1 : i])
            s += math.log(rest[k - 1] / (n[context] - own[context] if k > 1 else words) if k else 1 / max(words, 1)) + (allowed - k) * math.log(0.4)
        out.append((d, len(w), s))
    return sorted(out, key=lambda x: (x[0] is None, x))


@pytest.mark.parametrize("order,parts,size", [(2, 3, 1_000_000), (3, 2, 5_000), (3, 4, 300), (1, 1, 1_000_000)])
def test_score(docs, corpus, order, parts, size):
    rows = score(docs, order, parts=parts, range_grams=size).collect()
    got = sorted(((r["doc_id"], r["n_words"], r["score_micro"] / UNIT) for r in rows), key=lambda x: (x[0] is None, x))
    expected = scores(corpus, order)
    assert [x[:2] for x in got] == [x[:2] for x in expected]
    assert all(abs(a[2] - b[2]) <= 1e-5 * (1 + a[1]) for a, b in zip(got, expected))
    assert all(r["mean_score"] == (r["score_micro"] / r["n_words"] / UNIT if r["n_words"] else None) for r in rows)


def test_score_of_one_document(spark):
    rows = spark.createDataFrame([(1, "a b a b"), (2, "")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_words"], r["score_micro"]) for r in score(rows).collect()) == [(1, 4, round(UNIT * math.log(0.4)) + round(2 * UNIT * math.log(0.4)) + 2 * round(3 * UNIT * math.log(0.4))), (2, 0, 0)]


def test_score_empty(nothing):
    assert score(nothing).collect() == []


def cells(image, height, width):
    """Exact sums over a grid's cells, pixel by pixel."""
    h, w = image.shape
    out = [[Fraction(0)] * width for _ in range(height)]
    over = lambda i, n, k, parts: max(Fraction(0), min(Fraction(i + 1), Fraction((k + 1) * n, parts)) - max(Fraction(i), Fraction(k * n, parts)))
    for y in range(height):
        for x in range(width):
            out[y][x] = sum(int(image[i, j]) * over(i, h, y, height) * over(j, w, x, width) for i in range(h) for j in range(w))
    return out


def test_area_resize():
    rng = np.random.default_rng(4)
    for h, w, height, width in ((5, 7, 8, 9), (16, 9, 8, 9), (3, 3, 2, 5), (1, 1, 4, 4)):
        image = rng.integers(0, 256, (h, w), dtype=np.uint8)
        exact = cells(image, height, width)
        assert (area_sums(image, height, width) == np.array([[int(c * height * width) for c in row] for row in exact])).all()
        means = [[c * height * width / (h * w) for c in row] for row in exact]
        assert (resize(image[:, :, None], height, width)[:, :, 0] == np.array([[math.floor(m + Fraction(1, 2)) for m in row] for row in means])).all()


def test_decode():
    grey = np.arange(12, dtype=np.uint8).reshape(3, 4, 1) * 20
    assert (decode(encode_pgm(grey.tobytes(), 4)) == grey).all()
    assert (decode(b"P2 # c\n4 3\n# d\n255\n" + b" ".join(b"%d" % x for x in grey.ravel())) == grey).all()
    assert decode(b"P5 1 1 65535\n\x01\x02")[0, 0, 0] == 258
    assert decode(b"P6 1 1 255\n\x01\x02\x03").tolist() == [[[1, 2, 3]]]
    assert decode(b"P3 1 1 255\n1 2 3")[0, 0].tolist() == [1, 2, 3]
    assert decode(b"P1 3 2\n1 0 1\n010")[:, :, 0].tolist() == [[0, 1, 0], [1, 0, 1]]
    assert decode(b"P4 3 2\n\xa0\x40")[:, :, 0].tolist() == [[0, 1, 0], [1, 0, 1]]
    pixels = b"\x01\x02\x03\x04\x05\x06\x00\x00" + b"\x07\x08\x09\x0a\x0b\x0c\x00\x00"
    bmp = b"BM" + struct.pack("<IHHI", 54 + 16, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 2, 2, 1, 24, 0, 16, 0, 0, 0, 0) + pixels
    assert decode(bmp).tolist() == [[[9, 8, 7], [12, 11, 10]], [[3, 2, 1], [6, 5, 4]]]
    for broken in (b"", b"P5 2 2 255\n\x01", b"P7", b"P5 x", b"BM", bmp[:60], b"GIF89a"):
        with pytest.raises(ValueError):
            decode(broken)


def test_tiles(spark):
    good = encode_pgm(bytes(range(256)) * 4, 32)
    rows = [(1, good, "x"), (2, None, "y"), (3, b"nonsense", "z"), (3, b"nonsense", "z")]
    got = tiles(spark.createDataFrame(rows, "id long, media binary, tile string"), 8, 8).orderBy("id").collect()
    assert np.load(io.BytesIO(got[0]["tile"])).shape == (8, 8, 1) and got[0]["difference_hash"] == difference_hash(decode(good))
    assert tuple(got[1])[1:] == (None, None, None) and got[2]["media_error"] and got[2]["tile"] is None and len(got) == 4


def brute_hash(pixels):
    """The difference hash of rows of grey values, cell by cell."""
    sums = cells(np.array(pixels), 8, 9)
    bits = "".join("1" if row[k] > row[k + 1] else "0" for row in sums for k in range(8))
    return f"{int(bits, 2):016x}"


def bmp(image, bits, top_down=False):
    """A BMP of rows of (red, green, blue), or of grey values with a palette of inverted greys for 8 bits."""
    height, width = len(image), len(image[0])
    pixel = {8: lambda p: bytes([255 - p]), 24: lambda p: bytes(p[::-1]), 32: lambda p: bytes([*p[::-1], 9])}[bits]
    rows = [b"".join(map(pixel, row)) for row in image]
    rows = [r + bytes(-len(r) % 4) for r in (rows if top_down else rows[::-1])]
    palette = b"".join(bytes([255 - i] * 3 + [0]) for i in range(256)) if bits == 8 else b""
    head = struct.pack("<IiiHHIIiiII", 40, width, -height if top_down else height, 1, bits, 0, sum(map(len, rows)), 0, 0, 0, 0)
    return b"BM" + struct.pack("<IHHI", 54 + len(palette) + sum(map(len, rows)), 0, 0, 54 + len(palette)) + head + palette + b"".join(rows)


def test_bmp_round_trips(spark):
    """Pixels put into a BMP of each kind come out of it, and their tiles and hashes are those of the same picture as Netpbm."""
    rng = random.Random(6)
    for width, height in ((1, 1), (3, 5), (17, 9), (40, 33)):
        colours = [[tuple(rng.randrange(256) for _ in range(3)) for _ in range(width)] for _ in range(height)]
        greys = [[rng.randrange(256) for _ in range(width)] for _ in range(height)]
        for bits in (24, 32):
            for top_down in (False, True):
                assert decode(bmp(colours, bits, top_down)).tolist() == [[list(p) for p in row] for row in colours]
        assert decode(bmp(greys, 8)).tolist() == [[[g] * 3 for g in row] for row in greys]
        ppm = b"P6 %d %d 255\n" % (width, height) + b"".join(bytes(p) for row in colours for p in row)
        got = tiles(spark.createDataFrame([(1, bmp(colours, 24)), (2, ppm)], "id long, media binary"), 8, 8).orderBy("id").collect()
        assert got[0]["tile"] == got[1]["tile"] and got[0]["difference_hash"] == got[1]["difference_hash"] == brute_hash([[sum(p) for p in row] for row in colours])


def test_features(docs, corpus):
    got = {(r["doc_id"], r["media_sha256"]): r["feature"] for r in text_media(docs).collect()}
    for d, t, *_ in corpus:
        b = (t or "").encode()
        if len(b) < 2000:
            p = b + bytes(-len(b) % 64) or bytes(64)
            assert got[d, hashlib.sha256(b"P5\n64 %d\n255\n" % (len(p) // 64) + p).hexdigest()] == brute_hash([list(p[i : i + 64]) for i in range(0, len(p), 64)])


def test_text_media(docs, corpus, nothing):
    got = text_media(docs, with_media=True).collect()
    expected = []
    for d, t, *_ in corpus:
        b = (t or "").encode()
        p = b + bytes(-len(b) % 64) or bytes(64)
        media = b"P5\n64 %d\n255\n" % (len(p) // 64) + p
        expected.append((d, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(media), hashlib.sha256(media).hexdigest()))
    assert Counter(tuple(r)[:7] for r in got) == Counter(expected)
    assert all(np.load(io.BytesIO(r["tile"])).shape == (32, 32, 1) for r in got)
    assert text_media(nothing).collect() == []


def test_the_media_query_makes_each_tile(spark, docs, tmp_path):
    docs.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    got = op10_media(spark, str(tmp_path)).select("media_sha256", "tile_sha256").collect()
    expected = Counter((r["media_sha256"], hashlib.sha256(r["tile"]).hexdigest()) for r in text_media(docs, with_media=True).collect())
    assert Counter(map(tuple, got)) == expected
