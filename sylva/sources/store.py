"""Node tables written as Parquet: load once, then look at the table from as many sides as wanted, each reading only its columns and rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Up to so many rows a table may be broadcast.
LITTLE = 1 << 15


def folder(spark: SparkSession) -> str:
    """The folder for derived tables, which driver and executors share: spark.checkpoint.dir, or a temporary one where a local session sets none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-sylva-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new path in that folder."""
    return f"{folder(spark)}/{uuid.uuid4().hex}"


def stored(n: DataFrame, path: str | None = None) -> DataFrame:
    """n written under path (by default a new one in the scratch folder) and read again. It outlives lost executors.

    Spark takes the files' size for the rows', which may be a hundredth of it, and would broadcast millions of rows, or what is exploded from
    them. So a table of more than LITTLE rows asks for joins by sorting; the rows are counted from the files' footers.
    """
    path = path or scratch(n.sparkSession)
    n.write.parquet(path)
    return sized(n.sparkSession.read.schema(n.schema).parquet(path))


def sized(read: DataFrame) -> DataFrame:
    """A table just read from files, with the hint for joins by sorting if it has more than LITTLE rows."""
    return read if read.count() <= LITTLE else read.hint("merge")
