"""One large file read in as many tasks as byte ranges, cut at the ends of its records, to the node table that it gives as a whole.

Spark's text source cuts a file into ranges and synchronises on a line separator; here that is the records' close tag, so a row is a
record with what stands before it. Each row is scanned as a fragment of the element that holds the records, with ranks of its own; running
sums in a range's task, and a row a range, then stitch the ranks together. Nothing but the first record and one row a range is looked at in one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from sylva.functions.columns import plain_columns, slices
from sylva.functions.scan import clean, plain_rows
from sylva.functions.schema import ERROR, NODE, LoadOptions
from sylva.sources.store import stored
from sylva.sources.xml import ROWS, _batch, _of, _scanner, node_rows

#: The range, and how many nodes and tops of it come before a node's record.
_KEYS = [StructField("block", LongType()), StructField("before", LongType()), StructField("tops", LongType())]
_MADE = StructType([*_KEYS, StructField("message", StringType()), StructField("line", LongType()), *NODE.fields])


_AT = {f: i for i, f in enumerate(NODE.fieldNames())}


def _escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")


def _opening(row: tuple) -> str:
    """What opens a node: a tag, or a directive or declaration that holds what follows."""
    if row[_AT["node_type"]] != "ELEMENT":
        left, right = ("<?", "?>") if row[_AT["node_type"]] == "DIRECTIVE" else ("<!", ">")
        return f"{left}{row[_AT['str_value']]}{right}"
    return "".join([f"<{row[_AT['name']]}", *(f' {name}="{_escaped(value)}"' for name, value in row[_AT["attrs"]] or ()), ">"])


class _Head:
    """What stands before the first record: its nodes, and among them those that are open there, the record's parent last."""

    def __init__(self, doc_id: str, text: str, record: str, options: LoadOptions | None):
        self.record = re.compile(rf"<{re.escape(record)}(?=[\s>/])")
        found = self.record.search(text)
        if not found:
            raise ValueError(f"the first range of {doc_id} has no <{record}>")
        self.text, names = text[: found.start()], []
        for e in _scanner(self.text, options, True):
            if e.event == "ELEMENT_OPEN":
                names.append(e.name)
            elif e.event == "ELEMENT_CLOSE":
                names.pop()
        # An empty record ends what is open, as the first one does.
        rows = node_rows(doc_id, f"{self.text}<{record}/>" + "".join(f"</{x}>" for x in reversed(names)), options)
        self.rows = sorted(rows, key=lambda r: r[_AT["node_id"]])[:-1]
        self.open = [r for r in self.rows if r[_AT["last_desc"]] == len(self.rows)]
        if not names or len([r for r in self.open if r[_AT["node_type"]] == "ELEMENT"]) != len(names):
            raise ValueError(f"<{record}> is not within an element, or what stands before it can't be loaded")
        self.kids = [sum(r[_AT["parent_id"]] == o[_AT["node_id"]] for r in self.rows) for o in self.open]
        self.depth, self.before = self.open[-1][_AT["depth"]], "".join(map(_opening, self.open))
        self.top = (self.open[-1][_AT["name"]], {name: value for name, value in self.open[-1][_AT["attrs"]] or ()})

    def tail(self, doc_id: str, text: str, options: LoadOptions | None) -> tuple[list, list[tuple], list[int]]:
        """Of what stands after the last record: the errors; the nodes, with parents -1, -2 .. for the open nodes but the last; and how many nodes come after the end of each open one."""
        s, n = _scanner(self.before + text, options, False), len(self.open)
        for _ in s:
            pass
        rows = sorted(node_rows(doc_id, self.before + text, options), key=lambda r: r[_AT["node_id"]]) if not s.errors else []
        after, made = [len(rows) - 1 - r[_AT["last_desc"]] for r in rows[:n]], []
        for row in map(list, rows[n:]):
            up = row[_AT["parent_id"]]
            row[_AT["depth"]] += self.open[0][_AT["depth"]] - self.depth - 1
            row[_AT["node_id"]] -= n
            row[_AT["last_desc"]] -= n
            row[_AT["parent_id"]] = up - n if up >= n else None if up == n - 1 else -1 - up
            if up < n - 1:
                row[_AT["ord"]] += self.kids[up] - 1  # the next open one is there already
            made.append(tuple(row))
        return s.errors, made, after


def _scan(doc_id: str, head: _Head, record: str, options: LoadOptions | None, schema: StructType, elements: frozenset[str] | None):
    """Ranges, each in order, to their nodes, with ranks of their record and how many nodes and tops of the range come before it; errors; ends; and, without a node, how many there are up to a place."""
    opts, arrow, make = options or LoadOptions(None), to_arrow_schema(schema), _batch(schema)
    kinds = {f.name: f.type for f in arrow if f.name in NODE.fieldNames()[1:]} | ({} if elements is None else {"node_type": pa.string(), "name": pa.string()})
    names = None if elements is None else pa.array(sorted(elements), pa.string())
    # Where white space between records makes no nodes, a record is a plain document of its own.
    alone = (opts.type_of(*head.top) if opts.type_of else opts.value_type) == "IGNORE"

    def of_row(block: int, at_start: bool, text: str) -> tuple[list, list[tuple], list[int]]:
        if block == 0 and at_start and text.startswith(head.text) and head.record.match(text, len(head.text)):
            text = text[len(head.text) :]
        if not head.record.search(text):
            return head.tail(doc_id, text, options)
        text = f"{text}</{record}>"
        made = plain_rows(doc_id, text, opts, head.top) if clean(text) == (text, None) else None
        if made is not None:
            return [], made, []
        s = _scanner(text, options, False, head.top)
        for _ in s:
            pass
        return s.errors, node_rows(doc_id, text, options, head.top) if not s.errors else [], []

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, before, tops_before = -1, 0, 0
        for batch in batches:
            values = batch["value"]
            text = pc.ascii_ltrim(values, " \t\r\n")
            text = pc.if_else(pc.starts_with(text, f"<{record}"), pc.binary_join_element_wise(text, f"</{record}>", ""), "") if alone else pa.array([""] * len(values), pa.string())
            for part in slices(pa.record_batch([batch["block"], values, text], names=["block", "value", "text"]), 1):
                blocks = part["block"].to_numpy()
                plain, doc, made = plain_columns(part["text"], opts, kinds)
                counts, tops, rest, wrong = np.bincount(doc, minlength=len(blocks)), plain.astype(np.int64), {}, []
                for i in np.flatnonzero(~plain).tolist():
                    of = int(blocks[i])
                    errors, held, after = of_row(of, i == 0 and block != of or i > 0 and blocks[i - 1] != of, part["value"][i].as_py())
                    counts[i], tops[i], rest[i] = len(held), sum(r[_AT["parent_id"]] is None for r in held), held
                    if elements is not None:
                        rest[i] = [r for r in held if r[_AT["node_type"]] == "ELEMENT" and r[_AT["name"]] in elements]
                    wrong += [(of, 0, 0, message, line, *(None,) * len(NODE)) for line, message, _ in errors]
                    wrong += _ends(of, after)
                n0, t0 = np.cumsum(counts) - counts, np.cumsum(tops) - tops
                for start in np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1])).tolist():
                    same = blocks == blocks[start]
                    carried = (before, tops_before) if start == 0 and blocks[0] == block else (0, 0)
                    n0[same], t0[same] = n0[same] - n0[start] + carried[0], t0[same] - t0[start] + carried[1]
                block, before, tops_before = int(blocks[-1]), int(n0[-1] + counts[-1]), int(t0[-1] + tops[-1])
                if len(doc):
                    none, at = pa.nulls(len(doc), pa.string()), pa.array(doc)
                    own = {"block": part["block"].take(at), "before": pa.array(n0[doc]), "tops": pa.array(t0[doc]), "message": none, "line": none.cast(pa.int64()), "doc_id": pa.array([doc_id]).take(pa.array(np.zeros(len(doc), np.int64)))}
                    out = pa.record_batch([own[f.name] if f.name in own else made[f.name].cast(f.type) for f in arrow], schema=arrow)
                    yield out if names is None else out.filter(pc.and_(pc.equal(made["node_type"], "ELEMENT"), pc.is_in(made["name"], names)))
                upto = np.flatnonzero(np.append(blocks[1:] != blocks[:-1], True)).tolist()
                wrong += [(int(blocks[i]), int(n0[i] + counts[i]), int(t0[i] + tops[i]), None, None, *(None,) * len(NODE)) for i in upto]
                some = iter([*wrong, *((int(blocks[i]), int(n0[i]), int(t0[i]), None, None, *node) for i, held in rest.items() for node in held)])
                while more := list(islice(some, ROWS)):
                    yield make(more)

    return rows


def _ends(block: int, after: list[int]) -> Iterator[tuple]:
    """Rows that tell where the open nodes end: node_id the open node's number, last_desc the nodes after it; no document."""
    for i, n in enumerate(after):
        yield (block, 0, 0, None, None, *(i if f == "node_id" else n if f == "last_desc" else None for f in NODE.fieldNames()))


def read_records(spark: SparkSession, path: str, record: str, doc_id: str | None = None, options: LoadOptions | None = LoadOptions(), columns: Sequence[str] | None = None, elements: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The node table of one large file whose records are elements of one name below one element, and its errors (doc_id, line, message, fatal).

    The same nodes as a load of the whole file gives, or only these columns of them, and, after the first record begins, only elements of these names, with the ranks that they have among all. As many tasks as spark.sql.files.maxPartitionBytes makes of the file. The text must be UTF-8; the
    records' close tag is written without blanks and stands nowhere else, so not in comments or CDATA, and records don't hold records of their
    name. Other things may stand before, between and after them. doc_id: the path by default. If a record can't be loaded, there are no nodes;
    lines of errors count from the end of the record before. The scanned records are written once, with ranks of their own and their places in their
    range; what comes before a range is added as they are read, so that no nodes are shuffled and the table need not be stored again.
    """
    doc_id = doc_id or path
    rows = spark.read.text(path, lineSep=f"</{record}>").select(F.col("_metadata.file_block_start").alias("block"), "value")
    first = rows.filter("block = 0").first()
    head = _Head(doc_id, first["value"] if first else "", record, options)
    given = [c for c in NODE.fieldNames() if columns is None or c in columns]
    schema = _of(_MADE, [*_MADE.fieldNames()[:5], *(c for c in NODE.fieldNames() if c in {"doc_id", "node_id", "parent_id", "last_desc", *given})])
    plain = StructType([StructField(f.name, f.dataType) for f in schema])
    made = stored(rows.mapInArrow(_scan(doc_id, head, record, options, schema, None if elements is None else frozenset(elements)), plain))
    told = made.filter("doc_id is null and line is null")
    after = dict(told.filter("node_id is not null").select("node_id", "last_desc").collect())  # a row an open node
    wrong = made.filter("line is not null").select(F.lit(doc_id).alias("doc_id"), "line", "message")
    if not after:
        errors, _, ends = head.tail(doc_id, "", options)
        after = dict(enumerate(ends))
        wrong = wrong.unionByName(spark.createDataFrame([(doc_id, line, message) for line, message, _ in errors], "doc_id string, line long, message string"))
    # Looked up here: joined by doc_id, all nodes would meet in the one document's task.
    failed = not wrong.isEmpty()
    errors = wrong.withColumn("fatal", F.lit(True))
    local = made.filter("doc_id is not null").drop("message", "line")
    sizes = told.filter("node_id is null").groupBy("block").agg(F.max("before"), F.max("tops")).collect()  # a row a range
    starts, total, tops = [], len(head.rows), head.kids[-1]
    for block, n, more in sorted(map(tuple, sizes)):
        starts.append((block, total, tops))
        total, tops = total + n, tops + more
    open_ids = [r[_AT["node_id"]] for r in head.open]
    up, top = F.col("parent_id"), F.col("parent_id").isNull()
    outer = F.get(F.array(*map(F.lit, open_ids)), (-1 - up).cast("int")).cast("long")
    placed = {
        "node_id": F.col("node_id") + F.col("_n"), "last_desc": F.col("last_desc") + F.col("_n"), "parent_id": F.when(top, F.lit(open_ids[-1])).when(up < 0, outer).otherwise(up + F.col("_n")),
        "ord": lambda: (F.col("ord") + F.when(top, F.col("_t")).otherwise(0)).cast("int"), "depth": lambda: (F.col("depth") + head.depth + 1).cast("int"),
    }
    ranges = F.broadcast(spark.createDataFrame(starts, "block long, _n long, _t long"))
    shifted = local.join(ranges, "block").withColumns({"_n": F.col("before") + F.col("_n"), "_t": F.col("tops") + F.col("_t")})
    shifted = shifted.withColumns({c: x() if callable(x) else x for c, x in placed.items() if c in shifted.columns})
    last = lambda r: total - 1 - after.get(open_ids.index(r[_AT["node_id"]]), 0) if r[_AT["node_id"]] in open_ids else r[_AT["last_desc"]]
    above = spark.createDataFrame([tuple(last(r) if f == "last_desc" else x for f, x in zip(NODE.fieldNames(), r)) for r in head.rows], NODE)
    nodes = above.select(*given).unionByName(shifted.select(*given))
    return nodes.limit(0) if failed else nodes, errors.select(*ERROR.fieldNames())
