"""Connected components of an edge table, by rounds of hooking to the smallest neighbour (large-star and small-star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.llm.shared import Tables


def components(edges: DataFrame, tables: Tables, label: str = "cc") -> DataFrame:
    """node, component (the smallest node reachable) for every node of edges (a, b long), those equal to their component left out.

    Each round is written, so it survives lost executors. A hub's edges meet only in partial minima and in joins that Spark
    can split, as the minima are written, too. Rounds grow with the logarithm of the longest path.
    """
    now = tables.keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), f"{label}0")
    turn = 0
    while not _stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = tables.keep(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("m")), f"{label}{turn}least")
        large = both.filter("b > a").join(least, F.col("a") == F.col("c")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = tables.keep(large.distinct(), f"{label}{turn}large")
        least = tables.keep(large.groupBy(F.col("a").alias("c")).agg(F.min("b").alias("m")), f"{label}{turn}low")
        small = large.join(least, F.col("a") == F.col("c")).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        turn += 1
        now = tables.keep(small.filter("a > b").distinct(), f"{label}{turn}")
        tables.drop(*(f"{label}{turn - 1}{part}" for part in ("", "least", "large", "low")))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge down, to a node without any."""
    one = edges.agg(F.count("*").alias("n"), F.count_distinct("a").alias("nodes")).first()
    return one["n"] == one["nodes"] and edges.select("b").distinct().join(edges.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()
