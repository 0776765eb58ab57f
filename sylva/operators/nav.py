"""Navigation as arithmetic on pre-order ranks. Every join carries doc_id, so it is an equi-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from sylva.operators.running import nearest


def _siblings() -> WindowSpec:
    return Window.partitionBy("doc_id", "parent_id").orderBy("ord")


def parent(n: DataFrame) -> DataFrame:
    """n with `parent`: the parent's node_id, null at a root."""
    return n.withColumn("parent", F.col("parent_id"))


def first_child(n: DataFrame) -> DataFrame:
    return n.withColumn("first_child", F.when(F.col("last_desc") > F.col("node_id"), F.col("node_id") + 1))


def last_child(n: DataFrame) -> DataFrame:
    """n with `last_child`: one aggregation by parent and a join on it."""
    last = n.filter("parent_id is not null").groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.max("node_id").alias("last_child"))
    return n.join(last, ["doc_id", "node_id"], "left")


def next_sibling(n: DataFrame) -> DataFrame:
    return n.withColumn("next_sibling", F.when(F.col("parent_id").isNotNull(), F.lead("node_id").over(_siblings())))


def prev_sibling(n: DataFrame) -> DataFrame:
    return n.withColumn("prev_sibling", F.when(F.col("parent_id").isNotNull(), F.lag("node_id").over(_siblings())))


def ancestors(n: DataFrame) -> DataFrame:
    """doc_id, node_id, ancestor: every node with each node above it.

    A node's ancestor on a level is the last node of that level before it in pre-order. So each node is put down once for each level above
    it, and one running value by document and level gives the ancestor: as many rows as the result has, and one for each node. n is read twice.
    """
    by_level = n.select("doc_id", "node_id", "depth", F.explode(F.sequence(F.lit(0), F.col("depth"))).alias("level"))
    last = nearest(by_level, F.when(F.col("level") == F.col("depth"), F.col("node_id")), "ancestor", by={"_level": F.col("level")})
    return last.filter("level < depth").select("doc_id", "node_id", "ancestor")


def _top(n: DataFrame, top: DataFrame | None) -> DataFrame:
    """n inside each document's top node (doc_id, top, top_last), by default its root."""
    if top is None:
        top = n.filter("parent_id is null and ord = 0").select("doc_id", F.col("node_id").alias("top"), F.col("last_desc").alias("top_last"))
    return n.join(top, "doc_id").filter(F.col("node_id").between(F.col("top"), F.col("top_last")))


def after_subtree(node: Column, last: Column, top: Column, top_last: Column) -> Column:
    """The node after node's subtree within top; none from top itself."""
    return F.when((node != top) & (last < top_last), last + 1)


def walk_next(n: DataFrame, descend: str = "ALL", top: DataFrame | None = None) -> DataFrame:
    """n inside top with `next`: the next node in pre-order. descend ALL or FIRST enter children, NONE steps over them."""
    inside = _top(n, top)
    node, last, t, until = (F.col(c) for c in ("node_id", "last_desc", "top", "top_last"))
    step = after_subtree(node, last, t, until) if descend == "NONE" else F.when(node < until, node + 1)
    return inside.withColumn("next", step)


def walk_prev(n: DataFrame, descend: str = "ALL", top: DataFrame | None = None) -> DataFrame:
    """n inside top with `prev`: the node before in pre-order, never top. NONE: the sibling before, or else the parent."""
    inside = _top(n, top)
    if descend != "NONE":
        return inside.withColumn("prev", F.when(F.col("node_id") - 1 > F.col("top"), F.col("node_id") - 1))
    before = F.lag("node_id").over(_siblings())
    up = F.when(F.col("parent_id") != F.col("top"), F.col("parent_id"))
    return inside.withColumn("prev", F.when(F.col("node_id") != F.col("top"), F.coalesce(before, up)))
