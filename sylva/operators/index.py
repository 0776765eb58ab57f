"""Indexes: matching elements of each document in the order of name and attribute value."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylva.operators.find import attr, matches


def index(nodes: DataFrame, element: str | None = None, attribute: str | None = None) -> DataFrame:
    """doc_id, pos (from 1), node_id, name, value of the elements with this name and attribute, in byte order, ties by node_id.

    With neither, all elements are in it and the root, too; with either, the root isn't. Sorted within each document:
    the shuffle is by doc_id.
    """
    rows = nodes.filter(matches(element, attribute) & (F.col("parent_id").isNotNull() if element or attribute else F.lit(True)))
    if element is None and attribute is None:
        rows = rows.unionByName(nodes.filter("parent_id is null and ord = 0 and node_type <> 'ELEMENT'"))
    value = attr(attribute) if attribute is not None else F.lit(None).cast("string")
    rows = rows.select("doc_id", "node_id", "name", value.alias("value"))
    order = Window.partitionBy("doc_id").orderBy("name", "value", "node_id")
    return rows.withColumn("pos", F.row_number().over(order)).select("doc_id", "pos", "node_id", "name", "value")


def index_find(ind: DataFrame, element: str | None = None, value: str | None = None) -> DataFrame:
    """The index's rows of this name and value, with nth: the place among the answers, as repeated calls would give them. Without either, all rows."""
    if element is not None:
        ind = ind.filter(F.col("name") == element)
    if value is not None:
        ind = ind.filter(F.col("value") == value)
    return ind.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")))


def index_enum(ind: DataFrame, call: int) -> DataFrame:
    """Each document's node that the call-th enumeration after a reset gives."""
    return ind.filter(F.col("pos") == call)


def index_reset(ind: DataFrame) -> DataFrame:
    """Each document's first node."""
    return index_enum(ind, 1)


def index_count(ind: DataFrame) -> DataFrame:
    return ind.groupBy("doc_id").agg(F.count("*").alias("n"))


def index_delete(ind: DataFrame) -> None:
    """Free what a cached index holds."""
    ind.unpersist()
