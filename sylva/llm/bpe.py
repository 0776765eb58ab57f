"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes cuts every text into chunks where its content says so, so equal passages of
different documents give equal chunks. Chunks that occur more than once are encoded once, by one holder; the
documents then take those ids by a join, encode what lies between themselves, and repair each chunk's joins:
the words beside a join are encoded again together with the words inside the chunk, more and more of them,
until the ids agree exactly with those that the chunk brought.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.llm.kernels import _BYTE, _power, slices
from sylva.llm.shared import Tables, text_bytes

#: The normalizer and the split pattern of tokenizers whose words, parted by blanks, are encoded independently.
NORMALIZER = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

NO_ID = -(1 << 63)


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next free one from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    free = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


class Encoder:
    """ids of whole texts, as the tokenizers library gives them without special tokens; words seen before come from a bounded memory.

    Words are runs of bytes other than [\\x20\\x09-\\x0D]. The tokenizer drops white space and joins nothing over it, so a
    text's ids are its words' ids in turn; __init__ refuses a tokenizer of which that isn't known.
    """

    MOST_WORDS = 600_000
    _PLAIN = re.compile("[!-;=-~À-ÖØ-öø-ÿ]+")  # without the < of special tokens
    _PARTS = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        form = json.loads(self.tokenizer.to_str())
        steps = [x["type"] for x in (form["normalizer"] or {}).get("normalizers", [])]
        split = ((form["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        marked = all("<" in x["content"] for x in form["added_tokens"])
        if steps != NORMALIZER or split.get("pattern") != {"Regex": SPLIT} or form["decoder"] is not None or not marked:
            raise ValueError(f"{path}: not known to encode words independently of each other")
        self._words: dict[bytes, bytes] = {}
        self._parts: dict[str, bytes] = {}
        self._letters = _byte_letters()
        self._names: list[bytes] | None = None

    def _part(self, part: str) -> bytes:
        mapped = part if part.isascii() else "".join([self._letters[b] for b in part.encode()])
        ids = array("I", [t.id for t in self.tokenizer.model.tokenize(mapped)]).tobytes()
        if len(self._parts) >= self.MOST_WORDS:
            self._parts.clear()
        self._parts[part] = ids
        return ids

    def _learn(self, words: set[bytes]) -> None:
        hard, known, part = [], self._parts.get, self._part
        for word in words:
            s = word.decode()
            if s.isascii() and s.isalpha():
                s = s.lower()
                self._words[word] = known(s) or part(s)
            elif self._PLAIN.fullmatch(s):
                self._words[word] = b"".join([known(p) or part(p) for p in self._PARTS.findall(s.lower())])
            else:
                hard.append(word)
        for k in range(0, len(hard), 1000):
            some = hard[k : k + 1000]
            for word, e in zip(some, self.tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)):
                self._words[word] = array("I", e.ids).tobytes()

    def encode(self, text: bytes) -> bytes:
        """ids of a text in UTF-8, as little-endian unsigned 32-bit integers."""
        words, out = text.split(), []
        for k in range(0, len(words), self.MOST_WORDS // 3):
            some = words[k : k + self.MOST_WORDS // 3]
            try:
                out.append(b"".join(map(self._words.__getitem__, some)))
            except KeyError:
                new = set(some).difference(self._words)
                if len(self._words) + len(new) > self.MOST_WORDS:
                    self._words.clear()
                    new = set(some)
                self._learn(new)
                out.append(b"".join(map(self._words.__getitem__, some)))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The text of ids in UTF-8, as the library's decode(ids, skip_special_tokens=False): no decoder, so tokens joined by a space."""
        if self._names is None:
            of = self.tokenizer.get_vocab(with_added_tokens=True)
            self._names = [b""] * (max(of.values()) + 1)
            for token, i in of.items():
                self._names[i] = token.encode()
        return b" ".join(map(self._names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """This process's encoder of a tokenizer file; Spark's tasks are the parallelism."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


# --- chunks -----------------------------------------------------------------------------------------------

WINDOW, LEAST, MOST = 32, 256, 1 << 14


def chunk_cuts(column: pa.Array, bits: int = 10) -> Iterator[list[int]]:
    """For each text the byte positions after which a chunk ends, its length last.

    A cut comes after a byte at which the hash of the last 32 bytes has its upper bits zero, at least LEAST and
    at most MOST bytes after the cut before.
    """
    for _, data, bounds in slices(column):
        n = len(data)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * _power(n, False), out=total[1:])
        at = np.zeros(0, np.int64)
        if n >= WINDOW:
            rolled = (total[WINDOW:] - total[:-WINDOW]) * _power(n, True)[: n - WINDOW + 1]
            at = np.flatnonzero(rolled >> np.uint64(64 - bits) == 0) + WINDOW
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            cuts, last = [], a
            for x in at[np.searchsorted(at, a + WINDOW) : np.searchsorted(at, b)].tolist():
                while x - last > MOST:
                    cuts.append((last := last + MOST) - a)
                if x - last >= LEAST:
                    cuts.append((last := x) - a)
            while b - last > MOST:
                cuts.append((last := last + MOST) - a)
            yield [*cuts, b - a]


_BLANK = re.compile(rb"[ \t-\r]")


def body(chunk: bytes) -> tuple[int, int]:
    """The part of a chunk between its first and its last blank, in whole words; (0, 0) where there is none."""
    first = _BLANK.search(chunk)
    if not first:
        return 0, 0
    last = max(map(chunk.rfind, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    return (first.end(), last) if last > first.end() else (0, 0)


def repair(encode, text: bytes, parts: list[tuple[int, int, bytes]]) -> bytes:
    """ids of a text, given (start, end, ids) of some of its parts, which begin and end beside blanks.

    Each gap is encoded with guard words of the parts beside it: one, then twice as many, until the guards' ids
    are those that the parts have there; a part that never agrees is encoded again with its gap.
    """
    out: list[bytes] = []
    parts = sorted(parts)
    at, before = 0, b""  # what is encoded so far ends at byte `at`, with the part `before` (text, ids) last
    ids_before = b""
    for start, end, ids in [*parts, (len(text), len(text), b"")]:
        part = text[start:end]
        left, right = before.split(), part.split()
        k = 1
        while True:
            lead, tail = left[-k:] if left else [], right[:k]
            a, z = encode(b" ".join(lead)), encode(b" ".join(tail))
            got = encode(b" ".join(lead) + b" " + text[at:start] + b" " + b" ".join(tail))
            if ids_before.endswith(a) and ids.startswith(z) and got.startswith(a) and got.endswith(z) and len(got) >= len(a) + len(z):
                out.append(got[len(a) : len(got) - len(z)])
                out.append(ids)
                at, before, ids_before = end, part, ids
                break
            if k >= max(len(left), len(right)):
                if out:
                    out.pop()
                out.append(encode(before + b" " + text[at:start] + b" " + part))
                at, before, ids_before = end, b"", b""
                break
            k *= 2
    return b"".join(out)


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """k: doc_id, or NO_ID for null (so the least long, if given as a doc_id, counts as null); h: a hash of the text, which parts rows with one doc_id; text: never null; and the columns asked for."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k"), F.xxhash64(text).alias("h"), text.alias("text"), *more)


def _cut(bits: int):
    schema = pa.schema([("k", pa.int64()), ("h", pa.int64()), ("start", pa.int32()), ("size", pa.int32()), ("hash", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, h, start, size, digest = [], [], [], [], []
            texts = text_bytes(batch["text"])
            for a, b, text, cuts in zip(batch["k"].to_pylist(), batch["h"].to_pylist(), texts, chunk_cuts(batch["text"], bits)):
                x = 0
                for y in cuts:
                    k.append(a), h.append(b), start.append(x), size.append(y - x), digest.append(xxhash.xxh3_128_digest(text[x:y]))
                    x = y
            yield pa.record_batch([k, h, start, size, digest], schema=schema)

    return rows


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            yield pa.record_batch([part["k"], part["h"], pa.array([zlib.compress(t, 1) for t in text_bytes(part["text"])], pa.binary())], names=["k", "h", "text"])


def _hold(path: str):
    schema = pa.schema([("hash", pa.binary()), ("size", pa.int32()), ("lead", pa.int32()), ("ids", pa.binary()), ("bytes", pa.int32())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, before = encoder(path).encode, None
        for batch in batches:
            out = []
            for k, h, text, own in zip(batch["k"].to_pylist(), batch["h"].to_pylist(), batch["text"].to_pylist(), batch["own"].to_pylist()):
                if (k, h) == before:  # a repeated row would hold its chunks again; the join brings such rows side by side
                    continue
                before, text = (k, h), zlib.decompress(text)
                for x in own or []:
                    chunk = text[x["start"] : x["start"] + x["size"]]
                    a, b = body(chunk)
                    out.append((x["hash"], x["size"], a, zlib.compress(encode(chunk[a:b]), 1), b - a))
            yield pa.record_batch([list(c) for c in zip(*out)] if out else [[], [], [], [], []], schema=schema)

    return rows


def _finish(path: str, with_ids: bool):
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("n_chunks_reused", pa.int64())]
    schema = pa.schema(fields + ([("ids", pa.binary()), ("decoded", pa.string())] if with_ids else []))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            out = []
            for k, text, reused in zip(batch["k"].to_pylist(), map(zlib.decompress, batch["text"].to_pylist()), batch["reused"].to_pylist()):
                at = {x["start"] + x["lead"]: x for x in reused or [] if x["bytes"]}
                parts = [(start, start + x["bytes"], zlib.decompress(x["ids"])) for start, x in at.items()]
                ids = repair(e.encode, text, parts) if parts else e.encode(text)
                decoded = e.decode(ids)
                own = (None if k == NO_ID else k, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest(), len(parts))
                out.append((*own, ids, decoded.decode()) if with_ids else own)
            yield pa.record_batch([list(c) for c in zip(*out)] if out else [[] for _ in schema], schema=schema)

    return rows


def encode_decode(docs: DataFrame, tokenizer: str, bits: int = 10, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_chunks_reused of every row of docs (doc_id, text); with_ids: also ids and decoded.

    tokenizer: a tokenizers JSON file that all executors can open. bits: chunks average 2**bits bytes. Null text
    counts as empty (0 tokens), null doc_id stays null, repeated rows give repeated rows, other columns are left.
    The texts are shuffled once, compressed; chunk hashes (twice) and reused chunks' ids besides. Work is in proportion to the rows, repeated ones too.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "bpe")
    # Equal rows are one row here, else each of them would get the chunks of all.
    chunks = tables.keep(keyed(docs).mapInArrow(_cut(bits), "k long, h long, start int, size int, hash binary").distinct(), "chunks")
    holder = chunks.groupBy("hash", "size").agg(F.count("*").alias("n"), F.min(F.struct("k", "h", "start")).alias("at")).filter("n > 1")
    own = holder.groupBy("at.k", "at.h").agg(F.collect_list(F.struct("at.start", "size", "hash")).alias("own"))
    # Both joins shuffle the same rows, so one exchange serves them; the filter that the inner join needs is given to both.
    texts = keyed(docs).mapInArrow(_packed, "k long, h long, text binary").filter("k is not null and h is not null")
    held = texts.join(own, ["k", "h"]).select("k", "h", "text", "own").mapInArrow(_hold(tokenizer), "hash binary, size int, lead int, ids binary, bytes int")
    reused = chunks.join(held, ["hash", "size"]).groupBy("k", "h").agg(F.collect_list(F.struct("start", "lead", "bytes", "ids")).alias("reused"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_chunks_reused long"
    return texts.join(reused, ["k", "h"], "left").select("k", "text", "reused").mapInArrow(_finish(tokenizer, with_ids), schema + (", ids binary, decoded string" if with_ids else ""))
