"""Pieces that the operators of this subpackage share: the scratch tables in the shared folder, and helpers for columns."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.sources.store import folder

#: The characters that end a word or pad a line: space and the range from tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"


class Tables:
    """Written tables of one run of an operator. They survive lost executors; those no longer needed are dropped."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, f"{folder(spark)}/{label}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as Parquet and read it again; the shuffle files of the write are freed."""
        path, key = f"{self.root}/{name}", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        old = self.spark.conf.get(key, None)
        self.spark.conf.set(key, "true")
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            self.spark.conf.unset(key) if old is None else self.spark.conf.set(key, old)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the whole text (null becomes empty), and the columns asked for; other columns are not read."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each value of a string column."""
    return column.cast(pa.binary()).to_pylist()
