"""A corpus pipeline of five operators. Each stage reads the Parquet that the one before wrote; all but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.llm.lines import LineDedup
from sylva.llm.near import near_duplicates
from sylva.llm.packing import pack
from sylva.llm.quality import judge, ledger
from sylva.llm.queries import tokenizer_path
from sylva.llm.shared import Tables
from sylva.llm.substrings import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


REST = ("lang", "source")


def _counted(cleaned: DataFrame) -> DataFrame:
    """Rows of documents with the n_chars of their texts."""
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the production policy keeps."""
    return judge(ledger(docs, "text", "lang", "source", "n_chars")).filter("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more hold go."""
    lines = LineDedup(spark, min_docs=10, min_chars=1)
    return _counted(lines.apply(lines.insert(lines.empty(), docs), docs, with_text=True, carry=REST))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates, all its rows; rows without doc_id stay."""
    kept = near_duplicates(docs, percent=80).filter("kept and doc_id is not null").select("doc_id")
    named = docs.filter("doc_id is not null").join(kept, "doc_id", "left_semi")
    return named.select(*COLUMNS).unionByName(docs.filter("doc_id is null").select(*COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages of 50 words or more that a document with a smaller doc_id holds go."""
    return _counted(remove_repeats(docs, length=50, with_text=True, carry=REST))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 4096 tokens."""
    return pack(docs, tokenizer_path(), room=4096, end=1)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("packing", packing)]

#: The last stage's tokens can't be had in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tables = spark.read.parquet(f"{sf_dir}/documents.parquet"), Tables(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = tables.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
