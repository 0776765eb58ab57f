"""An index that outlives its query: a table clustered by name and value, answered from without the node table, kept up by deltas.

Below its path lie `versions`, a list of the folders that make up each version, and those folders: entries, in Parquet files of ranges of (name, value, doc_id,
node_id), by the name's bucket, so that a lookup reads one bucket and, by the files' statistics, the row groups of its range; and, beside a delta's
entries, the documents that it replaces. A hot name or value is a range of many files. Old versions stay readable until vacuum().
There is one writer at a time; a write that fails lists no version, so nothing of it is seen.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from sylva.operators.find import attr, matches
from sylva.sources.store import sized

#: Folders of names.
BUCKETS = 32
_ENTRY = StructType([
    StructField("doc_id", StringType()), StructField("node_id", LongType()), StructField("parent_id", LongType()), StructField("last_desc", LongType()),
    StructField("depth", IntegerType()), StructField("ord", IntegerType()), StructField("name", StringType()), StructField("value", StringType()),
    StructField("gen", IntegerType()), StructField("bucket", IntegerType()),
])
_CHANGED = StructType([StructField("doc_id", StringType()), StructField("gen", IntegerType())])
_VERSION = StructType([
    StructField("version", IntegerType()), StructField("gen", IntegerType()), StructField("folder", StringType()), StructField("changes", StringType()),
    StructField("element", StringType()), StructField("attribute", StringType()),
])
_NODE = ("doc_id", "node_id", "parent_id", "last_desc", "depth", "ord", "name", "value")


def _bucket(name: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(name, F.lit("")).cast("binary")), F.lit(BUCKETS)).cast("int")


def entries(n: DataFrame, element: str | None = None, attribute: str | None = None) -> DataFrame:
    """The nodes that an index has, with their places in the tree: with neither name nor attribute all elements and the root, with either no root."""
    inner = F.col("parent_id").isNotNull() if element or attribute else F.lit(True)
    of = matches(element, attribute) & inner
    if element is None and attribute is None:
        of |= F.col("parent_id").isNull() & (F.col("ord") == 0)
    value = attr(attribute) if attribute is not None else F.lit(None).cast("string")
    return n.filter(of).select(*_NODE[:-1], value.alias("value"))


@dataclass(frozen=True)
class StoredIndex:
    """An index at a path; every call looks at its latest version, or at `version`."""

    spark: SparkSession
    path: str
    version: int | None = None

    def _versions(self) -> DataFrame:
        return self.spark.read.schema(_VERSION).json(f"{self.path}/versions")

    def _parts(self) -> list:
        """The latest version's folders: one of the base and one a delta since the last merge."""
        v = self._versions()
        at = F.lit(self.version) if self.version is not None else v.agg(F.max("version")).first()[0]
        parts = v.filter(F.col("version") == at).orderBy("gen").collect()
        if not parts:
            raise ValueError(f"{self.path} has no version {self.version}")
        return parts

    def _list(self, parts: list[tuple]) -> None:
        """The commit: a version is seen once its one file has been renamed to its place."""
        self.spark.createDataFrame(parts, _VERSION).coalesce(1).write.mode("append").json(f"{self.path}/versions")

    def _write(self, rows: DataFrame, gen: int) -> str:
        folder = f"entries-{uuid.uuid4().hex}"
        rows = rows.select(*_NODE, F.lit(gen).cast("int").alias("gen"), _bucket(F.col("name")).alias("bucket"))
        order = ("bucket", "name", "value", "doc_id", "node_id")
        rows.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        return folder

    def build(self, n: DataFrame, element: str | None = None, attribute: str | None = None) -> StoredIndex:
        """The first version, of a node table; it is read twice (once for the ranges), so store it if loading it is dear."""
        self._list([(0, 0, self._write(entries(n, element, attribute), 0), None, element, attribute)])
        return self

    def update(self, n: DataFrame, docs: DataFrame) -> StoredIndex:
        """A new version in which the documents docs (doc_id) have the nodes that they have in n, and none if they aren't in it. Of n only these are
        read into the index; other documents' entries are neither read nor written. Repeated and null doc_ids in docs count once and not at all."""
        parts = self._parts()
        gen, element, attribute = parts[-1]["gen"] + 1, parts[0]["element"], parts[0]["attribute"]
        changes = f"changed-{uuid.uuid4().hex}"
        docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(gen).cast("int").alias("gen")).filter("doc_id is not null").distinct().write.parquet(f"{self.path}/{changes}")
        changed = sized(self.spark.read.schema(_CHANGED).parquet(f"{self.path}/{changes}"))
        folder = self._write(entries(n, element, attribute).join(changed.select("doc_id"), "doc_id", "left_semi"), gen)
        self._list([(parts[0]["version"] + 1, *p[1:]) for p in map(tuple, parts)] + [(parts[0]["version"] + 1, gen, folder, changes, element, attribute)])
        return self

    def merge(self) -> StoredIndex:
        """A new version of one folder, with what all folders have now."""
        parts = self._parts()
        if len(parts) > 1:
            self._list([(parts[0]["version"] + 1, parts[-1]["gen"], self._write(self._valid(parts), parts[-1]["gen"]), None, parts[0]["element"], parts[0]["attribute"])])
        return self

    def _valid(self, parts: list, of: Column | None = None) -> DataFrame:
        """Entries that no later delta replaces. The condition is put to the folders first, so that only answers meet the lists of changed documents."""
        held = None
        for p in parts:
            rows = self.spark.read.schema(_ENTRY).parquet(f"{self.path}/{p['folder']}")
            rows = rows if of is None else rows.filter(of)
            held = rows if held is None else held.unionByName(rows)
        changes = [p["changes"] for p in parts if p["changes"]]
        if changes:
            latest = sized(self.spark.read.schema(_CHANGED).parquet(*(f"{self.path}/{c}" for c in changes))).groupBy("doc_id").agg(F.max("gen").alias("_latest"))
            held = held.join(latest, "doc_id", "left").filter(F.col("_latest").isNull() | (F.col("gen") >= F.col("_latest")))
        return held.select(*_NODE)

    def rows(self, element: str | None = None, value: str | None = None) -> DataFrame:
        """The entries (doc_id, node_id, parent_id, last_desc, depth, ord, name, value) of this name and value; without either, all. Reads
        the name's bucket only, and of it the row groups that may hold the value."""
        of = F.lit(True)
        if element is not None:
            # A literal, so that the bucket's folder is chosen while planning.
            of &= (F.col("bucket") == _bucket(F.lit(element))) & (F.col("name") == element)
        if value is not None:
            of &= F.col("value") == value
        return self._valid(self._parts(), None if element is None and value is None else of)

    def find(self, element: str | None = None, value: str | None = None) -> DataFrame:
        """rows() with nth, the place among the document's answers, as repeated calls would give them: by name, value and node_id. Only answers are shuffled."""
        order = Window.partitionBy("doc_id").orderBy("name", "value", "node_id")
        return self.rows(element, value).withColumn("nth", F.row_number().over(order))

    def table(self) -> DataFrame:
        """doc_id, pos, node_id, name, value: all entries as index.index() gives them."""
        order = Window.partitionBy("doc_id").orderBy("name", "value", "node_id")
        return self.rows().withColumn("pos", F.row_number().over(order)).select("doc_id", "pos", "node_id", "name", "value")

    def vacuum(self) -> None:
        """Delete the folders that the latest version doesn't name, and those of writes that failed. Nobody may be reading older versions."""
        live = {f for p in self._parts() for f in (p["folder"], p["changes"]) if f}
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        for status in fs.listStatus(root):
            name = status.getPath().getName()
            if name.startswith(("entries-", "changed-")) and name not in live:
                fs.delete(status.getPath(), True)
