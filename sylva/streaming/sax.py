"""Event streams: documents that arrive as files or rows, scanned to events; documents are independent, so no state is kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sylva.functions.schema import LoadOptions
from sylva.operators.running import nearest
from sylva.sources.xml import events, shred


def stream_files(spark: SparkSession, path: str, options: LoadOptions | None = LoadOptions(), as_nodes: bool = False, per_trigger: int = 1000) -> DataFrame:
    """A stream of the events (or nodes) of files as they arrive under a path; doc_id is the file's path."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", per_trigger).load(path)
    return (shred if as_nodes else events)(files, "content", "path", options)


def retained(of_events: DataFrame, keep: Column) -> DataFrame:
    """Events of a table or stream that a callback would retain: its own condition on the event's columns."""
    return of_events.filter(keep)


def until_stop(of_events: DataFrame, stop: Column) -> DataFrame:
    """Events of each document up to the first where the callback says stop, which ends that load. By document; a table, not a stream."""
    first = of_events.filter(stop).groupBy("doc_id").agg(F.min("seq").alias("_stop"))
    return of_events.join(first, "doc_id", "left").filter(F.col("_stop").isNull() | (F.col("seq") <= F.col("_stop"))).drop("_stop")


def unless_stopped(of: DataFrame, of_events: DataFrame, stop: Column) -> DataFrame:
    """A node table (or any table with doc_id) without the documents whose callback stops their load: a stopped load leaves nothing."""
    return of.join(of_events.filter(stop).select("doc_id").distinct(), "doc_id", "left_anti")


def with_parent(of_events: DataFrame) -> DataFrame:
    """The events of a table with parent_seq, the seq of the ELEMENT_OPEN that they lie in: what a callback sees as a node's parent.

    An event's parent is the last element opened before it one level up; one running value by document and level tells it.
    """
    opened = F.col("event") == "ELEMENT_OPEN"
    levels = F.array(F.struct(F.col("depth").alias("level"), F.lit(False).alias("up")), F.when(opened, F.struct((F.col("depth") + 1).alias("level"), F.lit(True).alias("up"))))
    both = of_events.withColumn("_l", F.explode(F.filter(levels, lambda x: x.isNotNull())))
    flat = both.withColumns({"_level": F.col("_l.level"), "_up": F.col("_l.up")}).drop("_l")
    within = nearest(flat, F.when(F.col("_up"), F.col("seq")), "parent_seq", at="seq", by={"_of": F.col("_level")})
    return within.filter("not _up").drop("_level", "_up")


def run(of_events: DataFrame, callback: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Give each arriving batch of events to a function."""
    return of_events.writeStream.foreachBatch(callback).option("checkpointLocation", checkpoint).start()


def event_counts(of_events: DataFrame) -> DataFrame:
    """event, n; over a stream a running count."""
    return of_events.groupBy("event").agg(F.count("*").alias("n"))
