"""Chat formatting with collapse of cumulative snapshots.

Logs often hold a conversation again each time it grows. Rolling hashes of turn prefixes find conversations that
are prefixes of longer ones; an anti-join leaves the maximal ones, which are then rendered. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylva.llm.shared import Tables


def template(role: Column, text: Column) -> Column:
    """One turn as it is rendered."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("\n<|end|>\n"))


def maximal(turns: DataFrame) -> DataFrame:
    """conv, n_turns of the conversations that no other one continues; of equal ones the smallest conv stays.

    turns: conv, place (1..n in a conversation), role, text. The hash of a prefix is the exclusive or of its turns'
    hashes, each over place, role and text, in two independent 64-bit halves.
    """
    rolled = lambda salt: F.bit_xor(F.xxhash64(F.lit(salt), "place", "role", F.col("role").isNull(), "text", F.col("text").isNull()))
    order = Window.partitionBy("conv").orderBy("place")
    prefix = turns.withColumns({"a": rolled(1).over(order), "b": rolled(2).over(order), "n_turns": F.max("place").over(Window.partitionBy("conv"))})
    key = ["place", "a", "b"]
    whole = prefix.filter("place = n_turns").groupBy(*key).agg(F.min("conv").alias("conv"))
    inner = prefix.filter("place < n_turns").select(*key).distinct()
    return whole.join(inner, key, "left_anti").select("conv", F.col("place").alias("n_turns"))


def format_chats(log: DataFrame) -> DataFrame:
    """conv_id, n_turns, text (rendered) of the maximal conversations of log (conv_id, turn, role, text).

    Turns go by (turn, role, text), nulls first; a row logged twice is one turn. Null roles render as 'user', null texts as empty,
    though neither is equal to those when conversations are compared. A row with null conv_id is a conversation of its own, of one turn.
    A conversation is one row of the result, so its turns meet in one task, as the row they become must.
    """
    tables = Tables(log.sparkSession, "chat")
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    # Rows that name no conversation are told apart by what they say, so they don't gather under the null.
    alone = F.when(F.col("conv_id").isNull(), F.struct("turn", "role", "text"))
    logged = log.select("conv_id", "turn", "role", "text").distinct().withColumn("conv", F.struct(F.col("conv_id").isNull().alias("loose"), F.col("conv_id").alias("id"), alone.alias("alone")))
    turns = tables.keep(logged.withColumn("place", F.row_number().over(order)), "turns")
    said = turns.join(maximal(turns), "conv").select("conv", "n_turns", "place", template(F.coalesce("role", F.lit("user")), F.coalesce("text", F.lit(""))).alias("said"))
    each = said.groupBy("conv", "n_turns").agg(F.sort_array(F.collect_list(F.struct("place", "said"))).alias("all"))
    return each.select(F.col("conv.id").alias("conv_id"), F.col("n_turns").cast("long").alias("n_turns"), F.array_join(F.transform("all", lambda x: x["said"]), "").alias("text"))
