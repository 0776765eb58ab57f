"""Language-model scores by stupid backoff, computed relationally.

Texts are held in slices of bounded size. A slice's distinct n-grams are exploded into rows dealt by hash range, a row for
each slice and range; grouped by range they make the count table of that part of the hash space, and each row takes the counts
of its n-grams from it. The counts go back to their slices by a join, and every place of a document is scored
by what the rest of the corpus says: counts less the document's own.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.llm.kernels import Words, mix, runs, slices
from sylva.llm.shared import Tables, id_text

#: Scores are added as integers of this fraction of a nat, so that sums don't depend on their order.
UNIT = 1_000_000


def _hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of texts: doc_ids (list), bounds (int64 bytes), data (compressed), n_words."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        for first, data, bounds in slices(batch["text"]):
            n = len(Words(data, bounds).start)
            ids = pa.array([batch["doc_id"][first : first + len(bounds) - 1].to_pylist()], pa.list_(pa.int64()))
            yield pa.record_batch([ids, [bounds.astype("<i8").tobytes()], [pack(data.tobytes())], [n]], schema=_HELD)


_HELD = pa.schema([("doc_ids", pa.list_(pa.int64())), ("bounds", pa.binary()), ("data", pa.binary()), ("n_words", pa.int64())])


class _Grams:
    """The n-grams of a slice, up to an order. ids[n-1][i]: the hash of the n-gram that ends at word i; whole[n-1][i]: whether one document holds it."""

    def __init__(self, bounds: bytes, data: bytes, order: int):
        self.bounds = np.frombuffer(bounds, "<i8")
        words = Words(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8), self.bounds)
        hashes = words.hashes()
        self.n, self.first = len(hashes), words.first
        self.doc = np.repeat(np.arange(len(self.bounds) - 1), np.diff(words.first))
        self.ids, self.whole = [], []
        for n in range(1, order + 1):
            ids, whole = np.zeros(self.n, np.uint64), np.zeros(self.n, bool)
            if self.n >= n:
                ids[n - 1 :] = mix(runs(hashes, n) ^ np.uint64(n))
                whole[n - 1 :] = self.doc[: self.n - n + 1] == self.doc[n - 1 :]
            self.ids.append(ids), self.whole.append(whole)

    def all_ids(self) -> np.ndarray:
        return np.concatenate([i[w] for i, w in zip(self.ids, self.whole)])


def range_of(ids: np.ndarray, ranges: int) -> np.ndarray:
    """Which of so many ranges of the hash space, which follow each other, each hash lies in."""
    return ((ids >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _counts(values: np.ndarray) -> bytes:
    """Counts in the least number of bytes each."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0)))).tobytes()


def _explode(order: int, low: int, high: int, ranges: int):
    """The distinct n-grams of each slice in hash ranges low..high-1: range, slice, ids (sorted), tf."""
    schema = pa.schema([("range", pa.int64()), ("slice", pa.int64()), ("ids", pa.binary()), ("tf", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, bounds, data in zip(batch["slice"].to_pylist(), batch["bounds"], batch["data"]):
                ids = _Grams(bounds.as_py(), data.as_py(), order).all_ids()
                of = range_of(ids, ranges)
                ids, tf = np.unique(ids[(of >= low) & (of < high)], return_counts=True)
                own, starts = np.unique(range_of(ids, ranges), return_index=True)
                ends = [*starts.tolist()[1:], len(ids)]
                made = [(r, s, ids[a:b].tobytes(), _counts(tf[a:b])) for r, a, b in zip(own.tolist(), starts.tolist(), ends)]
                yield pa.record_batch([list(c) for c in zip(*made)] if made else [[], [], [], []], schema=schema)

    return rows


def _count(table: pa.Table) -> pa.Table:
    """The count table of a hash range, and what each slice takes from it: slice, range, counts (in the order of its ids)."""
    ids = [np.frombuffer(x, np.uint64) for x in table["ids"].to_pylist()]
    tf = [np.frombuffer(x, f"<u{len(x) // len(i)}") for x, i in zip(table["tf"].to_pylist(), ids)]
    gram, place = np.unique(np.concatenate(ids), return_inverse=True)
    total = np.bincount(place, np.concatenate(tf), len(gram)).astype(np.int64)
    at, pack = np.cumsum([0, *map(len, ids)]).tolist(), zstandard.ZstdCompressor(level=1).compress
    counts = [pack(_counts(total[place[a:b]])) for a, b in zip(at[:-1], at[1:])]
    return pa.table({"slice": table["slice"], "range": table["range"], "counts": pa.array(counts, pa.binary())})


def place_scores(rest: list[np.ndarray], whole: list[np.ndarray], rest_words: np.ndarray, factor: float) -> np.ndarray:
    """Millionths of a nat at each place, from the counts outside its document (rest[n-1]: of the n-gram that ends there; rest_words: of all words)."""
    steps = np.zeros(len(rest_words), np.int64)
    value, done = np.zeros(len(rest_words)), np.zeros(len(rest_words), bool)
    for n in range(len(rest), 0, -1):
        hit = ~done & whole[n - 1] & (rest[n - 1] > 0)
        at = np.flatnonzero(hit)
        value[at] = np.log(rest[n - 1][at] / (rest_words[at] if n == 1 else rest[n - 2][at - 1])) + steps[at] * log(factor)
        done |= hit
        steps += whole[n - 1] & ~done
    at = np.flatnonzero(~done)
    value[at] = np.log(1 / np.maximum(rest_words[at], 1)) + steps[at] * log(factor)
    return np.rint(value * UNIT).astype(np.int64)


def _score(order: int, ranges: int, total: int, factor: float):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("score_micro", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for docs, bounds, data, seen in zip(batch["doc_ids"].to_pylist(), batch["bounds"], batch["data"], batch["seen"]):
                g = _Grams(bounds.as_py(), data.as_py(), order)
                length = np.diff(g.first)
                if g.n:
                    gram, place = np.unique(g.all_ids(), return_inverse=True)
                    _, size = np.unique(range_of(gram, ranges), return_counts=True)
                    held = [unpack(x["counts"]) for x in sorted(seen.as_py(), key=lambda x: x["range"])]
                    held = np.concatenate([np.frombuffer(x, f"<u{len(x) // n}").astype(np.int64) for x, n in zip(held, size.tolist())])
                    rest, at = [], 0
                    for ids, whole in zip(g.ids, g.whole):
                        m = int(whole.sum())
                        mixed, own = mix(ids[whole] + g.doc[whole].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), np.zeros(g.n, np.int64)
                        _, twin, often = np.unique(mixed, return_inverse=True, return_counts=True)
                        own[whole] = held[place[at : at + m]] - often[twin]
                        rest.append(own)
                        at += m
                    micro = place_scores(rest, g.whole, np.repeat(total - length, length), factor)
                    sums = np.diff(np.append(0, np.cumsum(micro))[g.first])
                else:
                    sums = np.zeros(len(docs), np.int64)
                yield pa.record_batch([pa.array(docs, pa.int64()), length.astype(np.int64), sums], schema=schema)

    return rows


def score(docs: DataFrame, order: int = 3, factor: float = 0.4, parts: int = 4, range_grams: int = 1_000_000) -> DataFrame:
    """doc_id, n_words, score_micro (the sum of log scores, in millionths) and mean_score of every row of docs (doc_id, text).

    Words are runs of other characters than [\\x20\\x09-\\x0D], taken as they are. All counts are those of the other documents
    (rows): the corpus's less the own. A word's score is the count of the longest n-gram (n up to `order`) that ends in it and
    that another document holds, over the count of its first n-1 words, times `factor` for each longer one that its document
    would have allowed; for single words the divisor is the number of words, and a word that no other document holds
    counts once, times `factor` once more. n-grams don't cross documents. Without words (null, empty): score 0, mean
    null. Repeated rows are documents of their own, so they see each other; null doc_ids stay null; other columns are left.

    parts: the n-grams of one part of the hash space are dealt and counted at a time, so the shuffle files of one part
    are on disk at once. range_grams: n-grams in a range, so that the ranges grow in number and not in size. An n-gram
    has at most one entry a slice, so a frequent one doesn't weigh on its range. A text is scored within one task.
    """
    tables = Tables(docs.sparkSession, "scoring")
    held = tables.keep(id_text(docs).mapInArrow(_hold, "doc_ids array<long>, bounds binary, data binary, n_words long").withColumn("slice", F.monotonically_increasing_id()), "slices")
    total = held.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("n")).first()["n"]
    each = -(-order * total // (parts * range_grams)) or 1
    seen = None
    for p in range(parts):
        grams = held.select("slice", "bounds", "data").mapInArrow(_explode(order, p * each, (p + 1) * each, parts * each), "range long, slice long, ids binary, tf binary")
        found = tables.keep(grams.groupBy("range").applyInArrow(_count, "slice long, range long, counts binary"), f"counts{p}")
        seen = found if seen is None else seen.unionByName(found)
    gathered = seen.groupBy("slice").agg(F.collect_list(F.struct("range", "counts")).alias("seen"))
    scored = held.join(gathered, "slice", "left").select("doc_ids", "bounds", "data", "seen").mapInArrow(_score(order, parts * each, total, factor), "doc_id long, n_words long, score_micro long")
    return scored.withColumn("mean_score", F.when(F.col("n_words") > 0, F.col("score_micro") / F.col("n_words") / UNIT))
