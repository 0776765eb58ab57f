"""Substring dedup by level-wise doubling.

Windows of `seed` words that repeat in several documents are the first candidates; only they are extended to twice
that length, and so on, the last time to the length asked for, until no candidates survive. At the first level one window
is looked at of each `length` words: of the seeds that a longer window holds, the one with the least hash, so
equal longer windows have equal seeds and none is missed. Windows shorter than that are proposed by 64-bit hashes; what is removed is
decided by 96 bits of two functions of their words' hashes, w and v.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.llm.bpe import NO_ID, keyed
from sylva.llm.kernels import Words, mix, runs, slices
from sylva.llm.shared import Tables


def levels(seed: int, length: int) -> list[int]:
    """seed, doubled until it would reach length, which is last."""
    out = [seed]
    while out[-1] < length:
        out.append(min(2 * out[-1], length))
    return out


def window_minima(values: np.ndarray, size: int) -> np.ndarray:
    """The place of the least of each `size` consecutive values, the leftmost if equal."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, low, span = np.arange(len(values)), values, 1
    while span < size:
        step = min(span, size - span)
        right = low[step:] < low[:-step]
        best = np.where(right, best[step:], best[:-step])
        low = np.where(right, low[step:], low[:-step])
        span += step
    return best


def _each(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text: its bytes, its words' starts and ends there, and their hashes."""
    for _, data, bounds in slices(column):
        words = Words(data, bounds)
        hashes = words.hashes()
        for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
            yield data[bounds[i] : bounds[i + 1]], words.start[a:b] - bounds[i], words.end[a:b] - bounds[i], hashes[a:b]


def _hashes(column: pa.Array) -> Iterator[np.ndarray]:
    for _, data, bounds in slices(column):
        words = Words(data, bounds)
        yield from np.split(words.hashes(), words.first[1:-1])


def _check(hashes: np.ndarray, length: int) -> np.ndarray:
    """32 bits more for each run of so many words, of another function of their hashes than runs(hashes, length)."""
    return (runs(mix(hashes ^ np.uint64(0xA5A5A5A55A5A5A5A)), length) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _pairs(w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of w and v; where different windows share w, one may come again."""
    order = np.argsort(w)
    w, v = w[order], v[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (v[1:] != v[:-1])
    return w[new], v[new]


def held(w: np.ndarray, v: np.ndarray, found_w: np.ndarray, found_v: np.ndarray) -> np.ndarray:
    """Which of the pairs (w, v) are among those found."""
    order = np.argsort(found_w, kind="stable")
    found_w, found_v = found_w[order], found_v[order]
    at, out = np.searchsorted(found_w, w), np.zeros(len(w), bool)
    while True:  # more than once only where different windows share w
        near = np.flatnonzero((at < len(found_w)) & ~out)
        near = near[found_w[at[near]] == w[near]]
        if not len(near):
            return out
        out[near] = found_v[at[near]] == v[near]
        at[near] += 1


def _seeds(hashes: np.ndarray, seed: int, length: int) -> np.ndarray:
    """For each window of `length` words its seed's hash."""
    short = runs(hashes, seed)
    return short[window_minima(short, length - seed + 1)]


def _emit_seeds(seed: int, length: int):
    schema = pa.schema([("k", pa.int64()), ("h", pa.int64()), ("w", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                own = [np.unique(_seeds(hashes, seed, length)).view(np.int64) for hashes in _hashes(part["text"])]
                n = [len(x) for x in own]
                yield pa.record_batch([np.repeat(part["k"].to_numpy(), n), np.repeat(part["h"].to_numpy(), n), np.concatenate(own) if own else np.zeros(0, np.int64)], schema=schema)

    return rows


def _emit_windows(seed: int, length: int, low: int, high: int):
    """The windows of `high` words in windows of `length` whose candidates of `low` words (for the first level: seeds) all repeat; whole windows with v."""
    last = high == length
    schema = pa.schema([("k", pa.int64()), ("h", pa.int64()), ("w", pa.int64())] + [("v", pa.int32())] * last)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, own, own_v = batch.slice(at, 500), [], []
                for (_, _, _, hashes), found in zip(_each(part["text"]), part["found"]):
                    places = candidates(hashes, np.array(found.as_py(), np.int64), seed, length, low, high)
                    w, v = runs(hashes, high)[places], _check(hashes, high)[places] if last else None
                    w, v = _pairs(w, v) if last else (np.unique(w), v)
                    own.append(w.view(np.int64)), own_v.append(v)
                n, none = [len(x) for x in own], [np.zeros(0, np.int64)]
                made = [np.repeat(part["k"].to_numpy(), n), np.repeat(part["h"].to_numpy(), n), np.concatenate(own or none)]
                if last:
                    made.append(np.concatenate(own_v or none).astype(np.int32))
                yield pa.record_batch(made, schema=schema)

    return rows


def _emit_whole(length: int):
    """All windows of the texts."""
    schema = pa.schema([("k", pa.int64()), ("h", pa.int64()), ("w", pa.int64()), ("v", pa.int32())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, h, (_, _, _, hashes) in zip(batch["k"].to_pylist(), batch["h"].to_pylist(), _each(batch["text"])):
                w, v = _pairs(runs(hashes, length), _check(hashes, length))
                yield pa.record_batch([np.full(len(w), k), np.full(len(w), h), w.view(np.int64), v], schema=schema)

    return rows


def candidates(hashes: np.ndarray, found: np.ndarray, seed: int, length: int, low: int, high: int) -> np.ndarray:
    """Places of the windows of `high` words that may repeat, given the hashes of those of `low` words that do."""
    n = len(hashes) - high + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    found = found.view(np.uint64)
    if low == seed:
        whole = np.isin(_seeds(hashes, seed, length), found)  # windows of `length` whose seed repeats
        spread = np.zeros(len(hashes) + 1, np.int64)
        for at in (np.flatnonzero(whole),):
            np.add.at(spread, at, 1)
            np.add.at(spread, at + length - high + 1, -1)
        return np.flatnonzero(np.cumsum(spread)[:n] > 0)
    here = np.isin(runs(hashes, low), found)
    return np.flatnonzero(here[:n] & here[high - low : high - low + n])


def _cover(length: int, with_text: bool, carry: tuple[str, ...]):
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
    schema = pa.schema(fields + [("text", pa.string())] * with_text)
    names = [*schema.names, *carry]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, out = batch.slice(at, 500), []
                for k, found, (data, start, end, hashes) in zip(part["k"].to_pylist(), part["found"], _each(part["text"])):
                    n, text = len(hashes), data.tobytes()
                    words, kept = text.split(), text
                    gone = np.zeros(n + 1, np.int64)
                    if len(found):
                        found_w, found_v = (found.values.field(c).to_numpy() for c in "wv")
                        hit = np.flatnonzero(held(runs(hashes, length), _check(hashes, length), found_w.view(np.uint64), found_v))
                        np.add.at(gone, hit, 1)
                        np.add.at(gone, hit + length, -1)
                        gone = np.cumsum(gone)[:n] > 0
                        words = [w for w, g in zip(words, gone.tolist()) if not g]
                        if with_text and gone.any():
                            # A removed word goes with the blanks after it.
                            until = np.append(start[1:], len(text))
                            kept = b"".join([text[: start[0]], *(text[s:e] for s, e, g in zip(start, until, gone.tolist()) if not g)])
                    own = (None if k == NO_ID else k, n, n - len(words), hashlib.sha256(b" ".join(words)).hexdigest())
                    out.append((*own, kept.decode()) if with_text else own)
                made = pa.record_batch([list(c) for c in zip(*out)] if out else [[] for _ in schema], schema=schema)
                yield pa.record_batch([*made.columns, *(part[c] for c in carry)], names=names)

    return rows


def remove_repeats(docs: DataFrame, length: int = 13, seed: int = 7, with_text: bool = False, carry: tuple[str, ...] = (), parts: int = 2) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of docs (doc_id, text).

    A word goes if it lies in a window of `length` words that also starts in a document with a smaller doc_id;
    windows are judged on docs, not on what is left. kept_sha256 is that of the kept words joined by a space. with_text: also
    the text that is left; unchanged where nothing is removed, else without the removed words and the blanks after each.
    carry: columns of docs that each row keeps, after the others. Null text has no words. Rows with one doc_id are one document with several texts: they don't make each other's words
    go. A null doc_id counts as smaller than all others. Texts of fewer than `length` words lose nothing; other columns are
    left. The texts are shuffled to their ids once for each level, the first level's hashes twice.

    parts: whole windows are dealt and decided in one part of the hash space after the other, so one part's shuffle files are on disk at once.
    """
    if not 0 < seed <= length:
        raise ValueError("seed must lie in 1..length")
    tables = Tables(docs.sparkSession, "substrings")
    chain = levels(seed, length)
    whole = keyed(docs, *carry)
    texts = whole.select("k", "h", "text")
    kind = "k long, h long, w long"
    found = texts.mapInArrow(_emit_seeds(seed, length), kind)
    whole_windows = texts.mapInArrow(_emit_whole(length), kind + ", v int")
    for size, longer in zip(chain, chain[1:]):
        often = found.groupBy("w").agg(F.count("*").alias("n")).filter("n > 1").select("w")
        again = tables.keep(found.join(often, "w").groupBy("k", "h").agg(F.collect_set("w").alias("found")), f"level{size}")
        some = texts.join(again, ["k", "h"])
        if longer < length:
            found = tables.keep(some.mapInArrow(_emit_windows(seed, length, size, longer), kind), f"windows{longer}")
        else:
            whole_windows = some.mapInArrow(_emit_windows(seed, length, size, length), kind + ", v int")
    whole_windows = tables.keep(whole_windows, "whole")
    gone = F.array().cast("array<struct<w:bigint,v:int>>")
    for part in range(parts):
        found = whole_windows.filter(F.pmod("w", F.lit(parts)) == part)
        often = found.groupBy("w", "v").agg(F.min("k").alias("first"), F.max("k").alias("last")).filter("first < last").select("w", "v", "first")
        again = found.join(often, ["w", "v"]).filter("k > first").groupBy("k", "h").agg(F.collect_set(F.struct("w", "v")).alias(f"found{part}"))
        whole = whole.join(tables.keep(again, f"gone{part}"), ["k", "h"], "left")
        gone = F.concat(gone, F.coalesce(f"found{part}", F.array().cast("array<struct<w:bigint,v:int>>")))
    tables.drop("whole")
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text
    out = ", ".join([out, *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)])
    return whole.select("k", "text", gone.alias("found"), *carry).mapInArrow(_cover(length, with_text, carry), out)
