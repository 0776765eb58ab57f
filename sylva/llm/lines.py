"""Line dedup with sharded cuckoo filters over exact reference counts, reversible document by document.

State: `logs`, tables of how many documents hold each line key, whose sums are the exact counts, and `filters`, one cuckoo
filter per shard of the key space with the keys that enough documents hold. Inserting documents adds a table to the log,
deleting them adds one of negative counts; keys that cross the bound by it enter or leave their shard's filter, so inserting and
deleting again leaves the state as it was. Only keys and shards that a change touches are worked on. To clean documents, their line
keys go to their shards and probe the filters there, and only hits are confirmed by a join with the counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.llm.bpe import NO_ID, keyed
from sylva.llm.shared import Tables, text_bytes

#: Tables in the log before they are merged.
MOST_LOGS = 8
_PAD = b" \t\n\x0b\x0c\r"


def line_keys(text: bytes, min_chars: int) -> list[bytes | None]:
    """For each \\n-split line: a 128-bit hash of the line without padding, A-Z lower-cased; None if it is shorter than min_chars."""
    out: list[bytes | None] = []
    for line in text.split(b"\n"):
        key = line.strip(_PAD).lower()
        long = len(key) >= min_chars and (min_chars <= 1 or len(key.decode()) >= min_chars)
        out.append(xxhash.xxh3_128_digest(key) if long else None)
    return out


class Cuckoo:
    """A cuckoo filter of 16-bit fingerprints, four to a bucket. insert() tells whether all keys found room."""

    def __init__(self, table: np.ndarray):
        self.table = table.copy()

    @classmethod
    def of(cls, keys: np.ndarray) -> Cuckoo:
        """A filter that holds these keys and has room for more."""
        buckets = 16
        while buckets * 2 < len(keys) + 1:
            buckets *= 2
        while True:
            made = cls(np.zeros((buckets, 4), np.uint16))
            if made.insert(keys):
                return made
            buckets *= 2

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """keys: 64-bit. Fingerprint and both buckets of each; the second is the first, xor a hash of the fingerprint."""
        prints = (keys >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        first = (keys & np.uint64(0xFFFFFFFF)).astype(np.int64) % len(self.table)
        return prints, first, first ^ self._hop(prints.astype(np.int64))

    def _hop(self, prints):
        return prints * 0x5BD1E995 % len(self.table)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, i, j = self._places(keys)
        return (self.table[i] == prints[:, None]).any(1) | (self.table[j] == prints[:, None]).any(1)

    def insert(self, keys: np.ndarray) -> bool:
        return all(self._put(int(mark), int(i), int(j)) for mark, i, j in zip(*self._places(keys)))

    def _put(self, mark: int, i: int, j: int) -> bool:
        for k in range(500):
            for at in (i, j):
                free = np.flatnonzero(self.table[at] == 0)
                if len(free):
                    self.table[at, free[0]] = mark
                    return True
            mark, self.table[j, k % 4] = int(self.table[j, k % 4]), mark
            i, j = j, j ^ self._hop(mark)
        return False

    def delete(self, keys: np.ndarray) -> None:
        """Take out keys that are in it; equal fingerprints of one bucket pair stand for each other."""
        for mark, i, j in zip(*self._places(keys)):
            at = next(((b, s) for b in (i, j) for s in range(4) if self.table[b, s] == mark), None)
            if at:
                self.table[at] = 0

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Cuckoo:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, 4))


def _longs(keys) -> np.ndarray:
    """The last 64 bits of each 128-bit key; the first four bytes pick the shard, so these are independent of it."""
    return np.frombuffer(b"".join(k[8:] for k in keys), np.uint64)


@dataclass
class State:
    """logs: tables (key binary, n long), which add up to the counts. filters: shard int, filter binary, of so many shards. n_often: keys in the filters."""

    logs: list[DataFrame]
    filters: DataFrame
    shards: int
    n_often: int
    tables: Tables
    version: int = 0

    @property
    def refs(self) -> DataFrame:
        """key, n_docs: the exact counts, keys that no document holds any more left out."""
        rows = self.logs[0]
        for more in self.logs[1:]:
            rows = rows.unionByName(more)
        rows = rows if len(self.logs) == 1 else rows.groupBy("key").agg(F.sum("n").alias("n"))
        return rows.filter("n > 0").select("key", F.col("n").alias("n_docs"))


def _doc_keys(min_chars: int):
    schema = pa.schema([("key", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                keys = [x for t in text_bytes(batch["text"][k : k + 2000]) for x in {*line_keys(t, min_chars)} - {None}]
                yield pa.record_batch([keys], schema=schema)

    return rows


def _updated(pdf: pd.DataFrame) -> pd.DataFrame:
    """A shard's filter after its changes: null if it has no room for them and must be made anew."""
    old, change = pdf["filter"].dropna(), pdf["change"]
    made = Cuckoo.from_bytes(old.iloc[0]) if len(old) else Cuckoo.of(np.zeros(0, np.uint64))
    made.delete(_longs(sorted(pdf.loc[change == -1, "key"])))
    fits = made.insert(_longs(sorted(pdf.loc[change == 1, "key"])))
    return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "filter": [made.to_bytes() if fits else None]})


def _made(pdf: pd.DataFrame) -> pd.DataFrame:
    """A shard's filter from all its keys."""
    return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "filter": [Cuckoo.of(_longs(sorted(pdf["key"]))).to_bytes()]})


def _blocks(min_chars: int, shards: int):
    """The line keys of texts on their way to their shards: for some texts and a shard the keys (16 bytes each) and their texts' k and h."""
    schema = pa.schema([("shard", pa.int32()), ("k", pa.binary()), ("h", pa.binary()), ("keys", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 5000):
                part = batch.slice(at, 5000)
                own = [{*line_keys(t, min_chars)} - {None} for t in text_bytes(part["text"])]
                each = np.frombuffer(b"".join(k for keys in own for k in keys), np.uint8).reshape(-1, 16)
                row = np.repeat(np.arange(part.num_rows), [len(keys) for keys in own])
                shard = each[:, :4].copy().view(">u4")[:, 0].astype(np.int64) % shards
                order = np.argsort(shard, kind="stable")
                shard, each, row = shard[order], each[order], row[order]
                k, h = (part[c].to_numpy()[row] for c in "kh")
                starts = np.flatnonzero(np.diff(shard, prepend=-1)).tolist()
                ends = [*starts[1:], len(shard)]
                made = [(int(shard[a]), k[a:b].tobytes(), h[a:b].tobytes(), each[a:b].tobytes()) for a, b in zip(starts, ends) if a < b]
                yield pa.record_batch([list(c) for c in zip(*made)] if made else [[], [], [], []], schema=schema)

    return rows


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys of blocks that their shard's filter holds."""
    schema = pa.schema([("k", pa.int64()), ("h", pa.int64()), ("key", pa.binary())])
    for batch in batches:
        for keys, k, h, data in zip(*(batch[c].to_pylist() for c in ("keys", "k", "h", "filter"))):
            each = np.frombuffer(keys, np.uint64).reshape(-1, 2)
            hit = np.flatnonzero(Cuckoo.from_bytes(data).contains(each[:, 1].copy()))
            yield pa.record_batch([np.frombuffer(k, np.int64)[hit], np.frombuffer(h, np.int64)[hit], [keys[16 * i : 16 * i + 16] for i in hit.tolist()]], schema=schema)


class LineDedup:
    """min_docs: documents that must hold a key for its lines to go. min_chars: code points of the shortest key.

    shards: parts of the key space at first; their number is doubled, and the filters made anew, when they hold more than shard_keys
    keys on average. So a shard's filter, and the group that makes it, stay below a few megabytes at any size.
    """

    def __init__(self, spark: SparkSession, min_docs: int = 10, min_chars: int = 1, shards: int = 64, shard_keys: int = 1 << 16):
        self.spark, self.min_docs, self.min_chars, self.shards, self.shard_keys = spark, min_docs, min_chars, shards, shard_keys

    def empty(self) -> State:
        none = self.spark.range(0)
        return State([none.select(F.lit(b"").alias("key"), F.col("id").alias("n"))], none.select(F.lit(0).alias("shard"), F.lit(b"").alias("filter")), self.shards, 0, Tables(self.spark, "lines"))

    def insert(self, state: State, docs: DataFrame) -> State:
        """The state with these documents' lines counted; each row of docs (text) counts as one document, whatever its doc_id."""
        return self._change(state, docs, 1)

    def delete(self, state: State, docs: DataFrame) -> State:
        """The state as if these documents, inserted before, had never been."""
        return self._change(state, docs, -1)

    def _change(self, state: State, docs: DataFrame, sign: int) -> State:
        text, tables, version = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text")), state.tables, state.version + 1
        delta = tables.keep(text.mapInArrow(_doc_keys(self.min_chars), "key binary").groupBy("key").agg((sign * F.count("*")).alias("n")), f"delta{version}")
        # Keys that cross the bound: what the log has of the keys that change, and the change.
        before = delta.select("key", F.lit(0).cast("long").alias("old"), "n") if not state.version else None
        if before is None:
            held = state.refs.join(delta.select("key"), "key", "left_semi").withColumnRenamed("n_docs", "old")
            before = delta.join(held, "key", "left").select("key", F.coalesce("old", F.lit(0)).alias("old"), "n")
        was, now = F.col("old") >= self.min_docs, F.col("old") + F.col("n") >= self.min_docs
        crossed = before.filter(was != now).select("key", F.when(now, 1).otherwise(-1).alias("change"))
        crossed = tables.keep(crossed, f"crossed{version}")
        n_often = state.n_often + (crossed.agg(F.sum("change").alias("n")).first()["n"] or 0)
        logs = [*state.logs, delta] if state.version else [delta]
        shards = state.shards
        while n_often > shards * self.shard_keys:
            shards *= 2
        made = State(logs, state.filters, shards, n_often, tables, version)
        if len(logs) > MOST_LOGS:
            made.logs = [tables.keep(made.refs.withColumnRenamed("n_docs", "n"), f"counts{version}")]
        own = F.pmod(F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int").alias("shard")
        anew = lambda keys: keys.select(own, "key").groupBy("shard").applyInPandas(_made, "shard int, filter binary")
        if shards != state.shards:
            made.filters = tables.keep(anew(self._often(made)), f"filters{version}")
            return made
        changed = crossed.select(own, "change", "key", F.lit(None).cast("binary").alias("filter"))
        touched = changed.select("shard").distinct()
        old = state.filters.join(touched, "shard", "left_semi").select("shard", F.lit(0).alias("change"), F.lit(None).cast("binary").alias("key"), "filter")
        updated = tables.keep(old.unionByName(changed).groupBy("shard").applyInPandas(_updated, "shard int, filter binary"), f"updated{version}")
        full = updated.filter("filter is null").select("shard")
        filters = updated.filter("filter is not null")
        if not full.isEmpty():
            filters = filters.unionByName(anew(self._often(made).withColumn("shard", own).join(full, "shard", "left_semi").select("key")))
        made.filters = tables.keep(filters.unionByName(state.filters.join(touched, "shard", "left_anti")), f"filters{version}")
        return made

    def _often(self, state: State) -> DataFrame:
        return state.refs.filter(F.col("n_docs") >= self.min_docs).select("key")

    def apply(self, state: State, docs: DataFrame, with_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
        """doc_id, n_lines, n_dropped, kept_sha256 of every row of docs (doc_id, text); with_text: also the kept text.

        carry: columns of docs that each row keeps, after the others. Null or empty text is one empty line. Padding-only lines have no key and stay. Null doc_ids stay null,
        repeated rows give repeated rows, other columns are left. All lines dropped leaves the empty text.
        """
        texts, shards, min_chars = keyed(docs, *carry), state.shards, self.min_chars
        blocks = texts.select("k", "h", "text").mapInArrow(_blocks(min_chars, shards), "shard int, k binary, h binary, keys binary")
        hits = blocks.join(state.filters.hint("merge"), "shard").mapInArrow(_probe, "k long, h long, key binary")
        gone = hits.join(self._often(state), "key").groupBy("k", "h").agg(F.collect_set("key").alias("gone"))
        fields = [("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())] + [("text", pa.string())] * with_text
        out_schema, names = pa.schema(fields), [*(name for name, _ in fields), *carry]

        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for k, text, keys in zip(batch["k"].to_pylist(), text_bytes(batch["text"]), batch["gone"].to_pylist()):
                    lines, kept = text.split(b"\n"), text
                    n = len(lines)
                    if keys:
                        keys = set(keys)
                        lines = [line for line, key in zip(lines, line_keys(text, min_chars)) if key not in keys]
                        kept = b"\n".join(lines)
                    own = (None if k == NO_ID else k, n, n - len(lines), hashlib.sha256(kept).hexdigest())
                    out.append((*own, kept.decode()) if with_text else own)
                own = pa.record_batch([list(c) for c in zip(*out)] if out else [[] for _ in out_schema], schema=out_schema)
                yield pa.record_batch([*own.columns, *(batch[c] for c in carry)], names=names)

        kind = "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + ", text string" * with_text
        kind = ", ".join([kind, *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)])
        return texts.join(gone, ["k", "h"], "left").select("k", "text", "gone", *carry).mapInArrow(clean, kind)
