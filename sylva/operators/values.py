"""Value accessors: of the node itself, or, for numbers, text and custom values, of an element's first child."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StringType, StructType

from sylva.operators.find import attr

OWN = {"CDATA": "str_value", "COMMENT": "str_value", "DECLARATION": "str_value", "DIRECTIVE": "str_value"}
OR_CHILD = {"INTEGER": ("int_value", 0), "REAL": ("real_value", 0.0), "OPAQUE": ("str_value", None), "CUSTOM": ("custom", None), "TEXT": ("str_value", None)}


def type_of(node_type: Column) -> Column:
    """IGNORE where there is no node."""
    return F.coalesce(node_type, F.lit("IGNORE"))


def own_value(kind: str) -> Column:
    """The string of a CDATA, COMMENT, DECLARATION or DIRECTIVE node, null for others."""
    return F.when(F.col("node_type") == kind, F.col(OWN[kind]))


def user_value(key: str) -> Column:
    """What user_data holds under a key; null without it."""
    return F.try_element_at("user_data", F.lit(key))


def element_name() -> Column:
    return F.when(F.col("node_type") == "ELEMENT", F.col("name"))


def attr_value(name: str) -> Column:
    return F.when(F.col("node_type") == "ELEMENT", attr(name))


def attr_at(index: int) -> Column:
    """The attribute (name, value) at a place from 0, null beyond the last."""
    return F.get("attrs", index) if index >= 0 else F.lit(None).cast("struct<name:string,value:string>")


def attr_count() -> Column:
    return F.coalesce(F.when(F.col("node_type") == "ELEMENT", F.size("attrs")), F.lit(0))


def value_of(nodes: DataFrame, of: DataFrame, kind: str, name: str = "value") -> DataFrame:
    """`of` (rows of nodes) with the value of a kind: the node's own if it has that type, for an element its first child's, else the default.

    The default is 0 for numbers, null for others. TEXT also gives {name}_ws. One equi-join on the child's place, of first children only; it is one by sorting, as
    the files that documents are made from tell nothing of their values' size, and a broadcast would hold all of these.
    """
    column, default = OR_CHILD[kind]
    child = nodes.filter((F.col("node_type") == kind) & (F.col("node_id") == F.col("parent_id") + 1)).select(F.col("doc_id").alias("_d"), F.col("node_id").alias("_n"), F.col(column).alias("_v"), F.col("ws").alias("_w"), F.col("parent_id").alias("_p"))
    near = (F.col("doc_id") == F.col("_d")) & (F.col("node_id") + 1 == F.col("_n")) & (F.col("node_id") == F.col("_p"))
    joined = of.join(child.hint("merge"), near, "left")
    own = F.col("node_type") == kind
    from_child = F.col("node_type") == "ELEMENT"
    value = F.when(own, F.col(column)).when(from_child, F.col("_v"))
    joined = joined.withColumn(name, value if default is None else F.coalesce(value, F.lit(default)))
    if kind == "TEXT":
        joined = joined.withColumn(f"{name}_ws", F.coalesce(F.when(own, F.col("ws")).when(from_child, F.col("_w")), F.lit(False)))
    return joined.drop("_d", "_n", "_v", "_w", "_p")


_RUN = StructType().add("doc_id", StringType()).add("node_id", LongType()).add("ord", IntegerType()).add("text", StringType()).add("n", LongType())


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words (doc_id, node_id, ord, ws, str_value) that follow each other in a batch, joined: the first one's place, their text, and how many aren't empty."""
    schema = to_arrow_schema(_RUN)
    for batch in batches:
        if not (size := batch.num_rows):
            continue
        ids, node, at = batch["doc_id"], batch["node_id"].to_numpy(), batch["ord"].to_numpy()
        begins = np.append(True, pc.not_equal(ids.slice(1), ids.slice(0, size - 1)).to_numpy(zero_copy_only=False))
        begins[1:] |= (node[1:] != node[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(begins)
        words = pc.fill_null(batch["str_value"], "")
        said = pc.binary_join_element_wise(pc.if_else(pc.fill_null(batch["ws"], False), " ", ""), words, "")
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(first, size).astype(np.int32)), said), "")
        n = np.add.reduceat(pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64), first)
        yield pa.record_batch([ids.take(pa.array(first)), pa.array(node[first]), pa.array(at[first]), text, pa.array(n)], schema=schema)


def words_of(nodes: DataFrame, of: DataFrame | Column, name: str = "text", count: str | None = None) -> DataFrame:
    """doc_id, node_id, text: the TEXT children of each element of `of` joined, with a space where there was white space.

    `of` is rows of nodes, or a condition, with which nodes are read once. count: a column for how many of these children aren't empty. Words are joined where they
    follow each other, within tasks; what is shuffled, once, are these runs, not words.
    """
    word = F.col("node_type") == "TEXT"
    asked = nodes.filter(word | of) if isinstance(of, Column) else nodes.filter(word)
    slim = asked.select("doc_id", F.when(word, F.col("parent_id")).otherwise(F.col("node_id")).alias("node_id"), F.when(word, F.col("ord")).otherwise(-1).cast("int").alias("ord"), *(F.when(word, F.col(c)).alias(c) for c in ("ws", "str_value")))
    if not isinstance(of, Column):
        # An element of `of` is a run before its first word.
        slim = slim.unionByName(of.select("doc_id", "node_id", F.lit(-1).alias("ord"), F.lit(False).alias("ws"), F.lit("").alias("str_value")))
    runs = slim.filter("doc_id is not null and node_id is not null").mapInArrow(_runs, _RUN)
    each = runs.groupBy("doc_id", "node_id").agg(F.min("ord").alias("_first"), F.sum("n").alias("_n"), F.sort_array(F.collect_list(F.struct("ord", "text"))).alias("_w")).filter("_first < 0")
    return each.select("doc_id", "node_id", *([F.col("_n").alias(count)] if count else []), F.array_join(F.col("_w.text"), "").alias(name))
