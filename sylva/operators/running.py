"""Running values over the nodes of a document, in two levels: within runs of ranks, then over these.

A window by document would bring all nodes of a large document into one task. Here a window sees at most CELL ranks, and what comes from
before is a row a run; small documents lie in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranks of a run, a power of two.
CELL = 1 << 14


def cell(at: str | Column) -> Column:
    """The run that a rank lies in."""
    return F.shiftright((F.col(at) if isinstance(at, str) else at).cast("long"), CELL.bit_length() - 1)


def nearest(df: DataFrame, value: Column, name: str, at: str = "node_id", by: dict[str, Column] | None = None, later: bool = False, own: bool = True, then: Column | None = None) -> DataFrame:
    """df with `name`: the last value that isn't null at or before each row in the order of `at` within doc_id and by; later: the first at or after it.

    own False: strictly before or after. `at` is a rank, unique within doc_id and by, or with rows of one rank in the order of `then`; doc_id and by are never null. df is read twice, so store it if it is dear.
    """
    keys = ["doc_id", *(by or {}), "_cell"]
    marked = df.withColumns({**(by or {}), "_value": value, "_cell": cell(at)})
    place, pick = (F.desc(at), F.min_by) if later else (F.asc(at), F.max_by)
    here = F.last("_value", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(place, *([] if then is None else [then])).rowsBetween(Window.unboundedPreceding, 0 if own else -1))
    ends = marked.groupBy(*keys).agg(pick("_value", F.when(F.col("_value").isNotNull(), F.col(at))).alias("_value"))
    runs = Window.partitionBy(*keys[:-1]).orderBy(F.desc("_cell") if later else F.asc("_cell")).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_carried", F.last("_value", ignorenulls=True).over(runs)).filter("_carried is not null").drop("_value")
    return marked.withColumn("_here", here).join(carried, keys, "left").select(*df.columns, F.coalesce("_here", "_carried").alias(name))
