"""Best-fit packing planned on the histogram of lengths.

Documents are encoded, ended and cut into pieces. The number of pieces of each length (at most `room` rows) goes
to the driver, which runs best-fit over those counts: sequences that have equal room left are handled together as a
run. The plan says which ranks within a length take which sequences; the pieces then take their slots by joining it
on length and rank.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylva.llm.bpe import encoder
from sylva.llm.shared import Tables, id_text, text_bytes

#: Up to so many plan rows (of about 50 bytes) are broadcast; a larger plan is joined by a shuffle.
BROADCAST_ROWS = 100_000


def plan(counts: dict[int, int], room: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit, longest first, over counts: (length, first rank, last rank, first sequence, pieces in each, offset of the first).

    Ranks from 0 count the pieces of a length. A range of ranks fills sequences one after the other, so many
    pieces in each. The result's size follows the number of lengths, not of pieces.
    """
    open_runs: dict[int, list[tuple[int, int]]] = {}  # room left: runs of sequences, first and past the last
    lefts: list[int] = []
    slots, opened = [], 0

    def give_back(left: int, run: tuple[int, int]) -> None:
        if left and run[0] < run[1]:
            if left not in open_runs:
                open_runs[left] = []
                insort(lefts, left)
            runs = open_runs[left]
            if runs and runs[-1][1] == run[0]:
                runs[-1] = (runs[-1][0], run[1])
            else:
                runs.append(run)

    for length in sorted(counts, reverse=True):
        todo, rank = counts[length], 0
        while todo:
            i = bisect_left(lefts, length)
            if i < len(lefts):
                left = lefts[i]
                first, last = open_runs[left].pop()
                if not open_runs[left]:
                    del open_runs[left], lefts[i]
            else:
                left, per = room, room // length
                first, last = opened, opened + -(-todo // per)
                opened = last
            per = left // length
            full = min(last - first, todo // per)
            if full:
                slots.append((length, rank, rank + full * per - 1, first, per, room - left))
                rank, todo = rank + full * per, todo - full * per
                give_back(left - per * length, (first, first + full))
            first += full
            if todo and first < last:  # those left fill no sequence up: fewer than `per`
                slots.append((length, rank, rank + todo - 1, first, per, room - left))
                give_back(left - todo * length, (first, first + 1))
                rank, todo, first = rank + todo, 0, first + 1
            give_back(left, (first, last))
    return slots


def _pieces(path: str, room: int, end: int):
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    closing = np.array([end], "<u4").tobytes()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch["doc_id"].to_pylist(), text_bytes(batch["text"])):
                ids = encode(text) + closing
                for k in range(0, len(ids), 4 * room):
                    part = ids[k : k + 4 * room]
                    out.append((doc, k // (4 * room), k // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.record_batch([list(c) for c in zip(*out)] if out else [[] for _ in schema], schema=schema)

    return rows


def pack(docs: DataFrame, tokenizer: str, room: int = 4096, end: int = 1, bucket_rows: int = 1_000_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: the place of every piece of every row of docs (doc_id, text).

    A document is its ids and the id `end`; only those longer than `room` are cut. Null text counts as empty: one
    token. Null doc_ids and repeated rows are packed like any others; other columns are left; no rows give no rows.
    Ranks within a length come from counts of (length, bucket) and row numbers inside a bucket, so a length that
    many pieces have is numbered by many tasks; a bucket holds about bucket_rows rows at most.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "packing")
    pieces = tables.keep(id_text(docs).mapInArrow(_pieces(tokenizer, room, end), "doc_id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    planned = plan(counts, room)
    slots = spark.createDataFrame(planned, "length long, low long, high long, sequence long, per long, at long")
    if len(planned) <= BROADCAST_ROWS:
        slots = F.broadcast(slots)
    buckets = max(256, -(-max(counts.values(), default=0) // bucket_rows))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.spark_partition_id()), F.lit(buckets)))
    dealt = tables.keep(dealt, "dealt")
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")
    starts = sizes.select("length", "bucket", before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = dealt.withColumn("inside", inside).join(starts, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("inside"))
    placed = ranked.join(slots, (ranked["length"] == slots["length"]) & F.col("rank").between(F.col("low"), F.col("high")))
    step = F.col("rank") - F.col("low")
    return placed.select(
        "doc_id", "piece", "start", ranked["length"], "ids_crc32",
        (F.col("sequence") + F.floor(step / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("at") + (step % F.col("per")) * ranked["length"]).cast("long").alias("offset"),
    )
