"""Phrase collocation mining by direct-address tiling.

Texts become units: sequences of some 2**19 words of one language. Words that are frequent enough get ids by frequency, so two
words that follow each other are a cell (left, right) of a table whose head is dense. Cells of the head, four by four tiles of 1024 by 1024
ids, are counted by bincount; the sparse rest is counted as sorted COO lists, dealt by the cell. A frequent
cell gets an id by frequency again, and the units are written with these ids: a phrase of m words at a place is the pair of the phrases of m - 1
words there and at the next place. What isn't frequent breaks a sequence, as no longer phrase with it can be frequent.

A unit sends each cell once, with its count. The cells of a tile are dealt in turn to so many stripes that a group of entries stays
small, and those of the sparse rest to buckets, so each group has all of its cells' entries and is bounded. Entries travel as compressed differences.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylva.llm.kernels import mix
from sylva.llm.shared import Tables, text_bytes

#: Words of a unit, ids of a tile's side, tiles of the head's side, entries of a group that adds up.
UNIT, SIDE, HEAD, ENTRIES = 1 << 19, 1 << 10, 4, 1 << 22
_END = 10
_TABLE = bytes(c + 32 if 65 <= c <= 90 else _END if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))
_BLANK = np.array([c in (_END, 9, 32) for c in range(256)])

UNITS = "unit long, lang string, n long, ids binary, words array<string>, counts binary"
SEQUENCE = "unit long, lang string, n long, ids binary"
WORDS = "unit long, lang string, part long, at binary, words array<string>, counts binary"
BLOCK = "unit long, lang string, part long, codes binary, counts binary"


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    schema = _arrow(ddl)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def tokens(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The words of the texts, lower-cased, and at which of them a new piece begins."""
    blob = b"\n".join(texts).translate(_TABLE)
    data = np.frombuffer(blob, np.uint8)
    blank = np.append(_BLANK[data], True)
    begins = np.flatnonzero(~blank[:-1] & np.append(True, blank[:-2])) if len(data) else np.zeros(0, np.int64)
    piece = np.cumsum(data == _END)[begins]
    return blob.split(), np.flatnonzero(np.diff(piece)) + 1


class _Unit:
    def __init__(self):
        self.numbers, self.next, self.parts, self.size = {}, count(), [], 0

    def add(self, texts: list[bytes]) -> None:
        words, gaps = tokens(texts)
        ids = np.fromiter(map(self.numbers.setdefault, words, self.next), np.int64, len(words))
        self.parts += [np.insert(ids, gaps, -1), np.array([-1])]
        self.size += len(words)

    def row(self, unit: int, lang: str) -> tuple:
        numbers = np.fromiter(self.numbers.values(), np.int64, len(self.numbers))
        dense = np.full(numbers.max(initial=-1) + 2, -1, np.int32)  # the last one, for -1
        dense[numbers] = np.arange(len(numbers))
        ids = dense[np.concatenate(self.parts)]
        counts = np.bincount(ids[ids >= 0], minlength=len(numbers))
        return unit, lang, self.size, zstandard.ZstdCompressor(level=1).compress(ids.tobytes()), [w.decode() for w in self.numbers], counts.astype(np.int32).tobytes()


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, made, open_units = TaskContext.get().partitionId(), count(), {}
    close = lambda lang: _batch([open_units.pop(lang).row(part << 32 | next(made), lang)], UNITS)
    for batch in batches:
        for at in range(0, batch.num_rows, 100):
            some = batch.slice(at, 100)
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(some["lang"].to_pylist(), text_bytes(some["text"])):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                u = open_units.setdefault(lang, _Unit())
                u.add(texts)
                if u.size >= UNIT:
                    yield close(lang)
            if sum(u.size for u in open_units.values()) >= 4 * UNIT:  # of many languages
                yield close(max(open_units, key=lambda x: open_units[x].size))
    for lang in list(open_units):
        yield close(lang)


def ranked(df: DataFrame, tables: Tables, name: str, *ties: str) -> DataFrame:
    """df (lang, f, ..) with `id`: the place by falling f within the language, from 0. Sorted in ranges; their sizes, a row a range and language, give each its first id."""
    placed = tables.keep(df.orderBy("lang", F.desc("f"), *ties).withColumn("_row", F.monotonically_increasing_id()), f"{name}-sorted")
    placed = placed.withColumn("_range", F.shiftright("_row", 33))
    before = Window.partitionBy("lang").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("lang", "_range").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    sizes = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return tables.keep(placed.join(sizes, ["lang", "_range"]).withColumn("id", F.col("_row") - F.col("_first") + F.col("_base")).drop("_row", "_range", "_first", "_base"), name)


def _parts(parts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each part with the places where it stands."""
    order = np.argsort(parts, kind="stable")
    for some in np.split(order, np.flatnonzero(np.diff(parts[order])) + 1) if len(parts) else ():
        yield int(parts[some[0]]), some


def _word_blocks(buckets: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit, lang, words, counts in zip(batch["unit"].to_pylist(), batch["lang"].to_pylist(), batch["words"], batch["counts"]):
                words, counts = words.values, np.frombuffer(counts.as_buffer(), np.int32)
                hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, text_bytes(words)), np.uint64, len(words))
                out = [(unit, lang, part, packed(at), words.take(pa.array(at)), packed(counts[at])) for part, at in _parts((hashes % np.uint64(buckets)).astype(np.int64))]
                yield _batch(out, WORDS)

    return rows


def _word_sums(least: int):
    def of_group(rows: pa.Table) -> pa.Table:
        words, counts = rows["words"].combine_chunks().flatten(), _joined(rows["counts"])
        sums = pa.table({"word": words, "f": counts}).group_by("word").aggregate([("f", "sum")]).filter(pc.field("f_sum") >= least)
        return pa.table({"lang": pa.array([rows["lang"][0].as_py()] * len(sums), pa.string()), "part": pa.array([rows["part"][0].as_py()] * len(sums), pa.int64()), "word": sums["word"], "f": sums["f_sum"]})

    return of_group


_ANSWER = "unit long, codes binary, ids binary"


def _word_answers(blocks: pa.Table, frequent: pa.Table) -> pa.Table:
    """For each unit the numbers of its frequent words, and their ids."""
    out = []
    if len(frequent):
        known, ids = frequent["word"].combine_chunks(), frequent["id"].to_numpy()
        for unit, at, words in zip(blocks["unit"].to_pylist(), blocks["at"].to_pylist(), blocks["words"]):
            found = pc.index_in(words.values, known).fill_null(-1).to_numpy(zero_copy_only=False)
            if (found >= 0).any():
                out.append((unit, packed(unpacked(at)[found >= 0]), packed(ids[found[found >= 0]])))
    return pa.Table.from_batches([_batch(out, _ANSWER)])


def _named(answers: pa.Table, units: pa.Table) -> pa.Table:
    """The unit with the ids of its frequent words; the others are breaks."""
    at, ids, out = _joined(answers["codes"]), _joined(answers["ids"]), []
    if len(at):
        for unit, lang, held in zip(units["unit"].to_pylist(), units["lang"].to_pylist(), units["ids"].to_pylist()):
            own = _held(held)
            to = np.full(int(own.max()) + 2, -1, np.int64)  # the last one, for -1
            to[at] = ids
            out.append(_sequence(unit, lang, to[own]))
    return pa.Table.from_batches([_batch(out, SEQUENCE)])


def _sequence(unit: int, lang: str, ids: np.ndarray) -> tuple:
    """A row of a sequence, with one break in place of several."""
    if ids.max(initial=0) >= 1 << 31:
        raise ValueError("more than 2**31 frequent phrases of one length and language")
    ids = ids[(ids >= 0) | (np.append(-1, ids[:-1]) >= 0)]
    return unit, lang, len(ids), zstandard.ZstdCompressor(level=1).compress(ids.astype(np.int32).tobytes())


def _held(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.int32)


def _codes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cells (left << 32 | right) of neighbours without a break, and where the left ones stand."""
    at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
    return ids[at].astype(np.int64) << 32 | ids[at + 1], at


class Deal:
    """How cells are dealt into parts: every so-manyth cell of a tile of the head to one stripe of it, and the rest to buckets."""

    def __init__(self, words: int):
        self.stripes, self.buckets = min(SIDE * SIDE, max(4, 1 << (words // ENTRIES).bit_length())), 4 + words // ENTRIES
        self.cells, self.head = SIDE * SIDE // self.stripes, HEAD * HEAD * self.stripes

    def part(self, codes: np.ndarray) -> np.ndarray:
        left, right = codes >> 32, codes & 0xFFFFFFFF
        rest = self.head + (mix(codes.view(np.uint64)) % np.uint64(self.buckets)).astype(np.int64)
        stripe = (left % SIDE * SIDE + right % SIDE) % self.stripes
        return np.where((left < HEAD * SIDE) & (right < HEAD * SIDE), (left // SIDE * HEAD + right // SIDE) * self.stripes + stripe, rest)

    def add_up(self, codes: np.ndarray, counts: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct cells of one part, sorted, and their sums: by bincount in a stripe that is filled enough, else by sorting."""
        if part < self.head and 16 * len(codes) >= self.cells:
            tile, stripe = part // self.stripes, part % self.stripes
            left, right = tile // HEAD * SIDE, tile % HEAD * SIDE
            sums = np.bincount((((codes >> 32) - left) * SIDE + (codes & 0xFFFFFFFF) - right) // self.stripes, counts, self.cells)
            cells = np.flatnonzero(sums)
            sums, cells = sums[cells].astype(np.int64), cells * self.stripes + stripe
            return (cells // SIDE + left) << 32 | (cells % SIDE + right), sums
        order = np.argsort(codes)
        codes, counts = codes[order], counts[order]
        if not len(codes):
            return codes, counts
        new = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
        return codes[new], np.add.reduceat(counts, new).astype(np.int64)


def packed(values: np.ndarray) -> bytes:
    """Numbers as compressed differences."""
    return zstandard.ZstdCompressor(level=1).compress(np.diff(values.astype(np.int64), prepend=0).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.int64))


def _blocks(deal: Deal):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit, lang, ids in zip(batch["unit"].to_pylist(), batch["lang"].to_pylist(), batch["ids"].to_pylist()):
                codes, _ = _codes(_held(ids))
                out = []
                for part, at in _parts(deal.part(codes)):
                    own, n = deal.add_up(codes[at], np.ones(len(at), np.int64), part)
                    out.append((unit, lang, part, packed(own), packed(n)))
                yield _batch(out, BLOCK)

    return rows


def _joined(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([unpacked(x) for x in column.to_pylist()] or [np.zeros(0, np.int64)])


def _sums(deal: Deal, least: int):
    def of_group(rows: pa.Table) -> pa.Table:
        codes, sums = deal.add_up(_joined(rows["codes"]), _joined(rows["counts"]), rows["part"][0].as_py())
        codes, sums = codes[sums >= least], sums[sums >= least]
        return pa.table({"lang": pa.array([rows["lang"][0].as_py()] * len(codes), pa.string()), "l": codes >> 32, "r": codes & 0xFFFFFFFF, "f": sums})

    return of_group


def _placed(deal: Deal):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch["l"].to_numpy() << 32 | batch["r"].to_numpy()
            yield pa.record_batch([batch["lang"], deal.part(codes), codes, batch["id"]], names=["lang", "part", "code", "id"])

    return rows


def _look_up(codes: np.ndarray, known: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The ids of codes among the known (sorted) ones, -1 for others."""
    if not len(known):
        return np.full(len(codes), -1, np.int64)
    at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
    return np.where(known[at] == codes, ids[at], -1)


def _answers(blocks: pa.Table, frequent: pa.Table) -> pa.Table:
    order = np.argsort(frequent["code"].to_numpy())
    known, ids, out = frequent["code"].to_numpy()[order], frequent["id"].to_numpy()[order], []
    if len(known):
        for unit, held in zip(blocks["unit"].to_pylist(), blocks["codes"].to_pylist()):
            codes = unpacked(held)
            found = _look_up(codes, known, ids)
            if (found >= 0).any():
                out.append((unit, packed(codes[found >= 0]), packed(found[found >= 0])))
    return pa.Table.from_batches([_batch(out, _ANSWER)])


def _longer(answers: pa.Table, units: pa.Table) -> pa.Table:
    """The unit's sequence of phrases one word longer."""
    codes, new, out = _joined(answers["codes"]), _joined(answers["ids"]), []
    order = np.argsort(codes)
    if len(codes):
        for unit, lang, held in zip(units["unit"].to_pylist(), units["lang"].to_pylist(), units["ids"].to_pylist()):
            ids = _held(held)
            cells, at = _codes(ids)
            made = np.full(len(ids), -1, np.int64)
            made[at] = _look_up(cells, codes[order], new[order])
            out.append(_sequence(unit, lang, made))
    return pa.Table.from_batches([_batch(out, SEQUENCE)])


def mine(docs: DataFrame, tables: Tables, least: int = 100, longest: int = 5) -> tuple[list[DataFrame], DataFrame]:
    """The stored tables of frequent phrases of 1, 2 .. words, and n (all words) of each lang.

    A table has lang, id (place by falling frequency), f, and word, or l and r: the ids of the phrases without the last and without the first word.
    """
    given = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    units, dealt = tables.keep(given.mapInArrow(_units, UNITS), "units"), ("lang", "part")
    totals = tables.keep(units.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    buckets = 4 + (totals.agg(F.sum("n")).first()[0] or 0) // ENTRIES
    blocks = tables.keep(units.mapInArrow(_word_blocks(buckets), WORDS), "blocks1")
    frequent = blocks.groupBy(*dealt).applyInArrow(_word_sums(least), "lang string, part long, word string, f long")
    levels = [ranked(frequent, tables, "level1", "word")]
    answers = blocks.select(*dealt, "unit", "at", "words").groupBy(*dealt).cogroup(levels[0].groupBy(*dealt)).applyInArrow(_word_answers, _ANSWER)
    sequence = tables.keep(answers.groupBy("unit").cogroup(units.select("unit", "lang", "ids").groupBy("unit")).applyInArrow(_named, SEQUENCE), "sequence1")
    tables.drop("units", "blocks1")
    for m in range(2, longest + 1):
        deal = Deal(sequence.agg(F.sum("n")).first()[0] or 0)
        blocks = tables.keep(sequence.mapInArrow(_blocks(deal), BLOCK), f"blocks{m}")
        cells = blocks.groupBy(*dealt).applyInArrow(_sums(deal, least), "lang string, l long, r long, f long")
        levels.append(ranked(cells, tables, f"level{m}", "l", "r"))
        if m < longest:
            placed = levels[-1].select("lang", "l", "r", "id").mapInArrow(_placed(deal), "lang string, part long, code long, id long")
            answers = blocks.select(*dealt, "unit", "codes").groupBy(*dealt).cogroup(placed.groupBy(*dealt)).applyInArrow(_answers, _ANSWER)
            longer = tables.keep(answers.groupBy("unit").cogroup(sequence.groupBy("unit")).applyInArrow(_longer, SEQUENCE), f"sequence{m}")
            sequence = longer
        tables.drop(f"blocks{m}", f"sequence{m - 1}")
    return levels, totals


def cut_score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (left * right)), exact for counts up to 10**17."""
    wide = lambda c: c.cast("decimal(18,0)")
    top = (wide(a) * wide(n)).cast("decimal(38,0)") * F.lit(1000).cast("decimal(4,0)")
    return F.call_function("div", top.cast("decimal(38,0)"), (wide(left) * wide(right)).cast("decimal(38,0)"))


def phrases(levels: list[DataFrame], totals: DataFrame, tables: Tables) -> DataFrame:
    """lang, phrase, words (how many), a, l, r, n, score of all frequent phrases of two words and more that lie in no longer phrase as frequent as they are."""
    none = F.array().cast("array<bigint>")
    own = levels[0].select("lang", "id", "f", F.col("word").alias("phrase"), F.col("word").alias("last"), none.alias("pre"), none.alias("suf"))
    out = None
    for m, level in enumerate(levels[1:], 2):
        a = own.select("lang", F.col("id").alias("l"), F.col("phrase").alias("head"), F.array_append("pre", F.col("f")).alias("pre"))
        b = own.select("lang", F.col("id").alias("r"), "last", F.array_append("suf", F.col("f")).alias("suf"))
        own = level.join(a, ["lang", "l"]).join(b, ["lang", "r"]).select("lang", "id", "f", F.concat_ws(" ", "head", "last").alias("phrase"), "last", "pre", "suf")
        own = tables.keep(own, f"phrases{m}")
        free = own
        if m < len(levels):
            longer = levels[m].select("lang", F.explode(F.array("l", "r")).alias("id"), "f").distinct()
            free = own.join(longer, ["lang", "id", "f"], "left_anti")
        cuts = [F.struct(cut_score(F.col("f"), F.col("n"), F.get("pre", F.lit(k - 1)), F.get("suf", F.lit(m - k - 1))).alias("score"), F.lit(k).alias("k"), F.get("pre", F.lit(k - 1)).alias("l"), F.get("suf", F.lit(m - k - 1)).alias("r")) for k in range(1, m)]
        scored = free.join(totals, "lang").withColumn("cut", F.array_min(F.array(*cuts)))
        rows = scored.select("lang", "phrase", F.lit(m).alias("words"), F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score")
        out = rows if out is None else out.unionByName(rows)
    return out


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases by falling score, falling a, and phrase in byte order.

    Texts (docs: text, lang) are cut at . , ; : ! ? and line ends into pieces, and these at blanks and tabs into words, A-Z lower-cased. A phrase of 2 to
    `longest` words is a candidate if it occurs a >= `least` times within pieces, overlaps included. Cut in two parts that occur l and r times among n
    words, it scores floor(1000 * a * n / (l * r)); the cut with the least score counts, the first of equal ones. A candidate in a longer one that occurs as often is dropped.

    Null texts are empty; a null lang is `und`; repeated rows count each time; doc_id isn't looked at, and other columns are left. An empty table has no rows.
    """
    tables = Tables(docs.sparkSession, "collocations")
    found = tables.keep(phrases(*mine(docs, tables, least, longest), tables), "phrases")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    # First within shares of a language, so that none is sorted whole in one task.
    share = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(256))).orderBy(*order)
    best = found.withColumn("place", F.row_number().over(share)).filter(F.col("place") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return best.withColumn("rank", rank).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
