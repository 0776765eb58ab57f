"""Saving: node tables to text, one row a document, to pieces as a write callback would take them, and to files.

A document's nodes are gathered and put in order by Spark, and joined by a small function that closes tags, keeps the column
for wrapping and calls the options' functions.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import islice
from urllib.parse import quote
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from sylva.functions.schema import SaveOptions, Written
from sylva.operators.whole import Nodes

TAB = 8


def escape(text: Column) -> Column:
    """Text with the five characters that markup needs replaced by entities."""
    for plain, entity in (("&", "&amp;"), ("'", "&apos;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def _flow(options: SaveOptions):
    """Joins a document's nodes (NODE_FIELDS, in order), keeping the column; and does so for batches of gathered documents."""

    def advance(text: str, column: int) -> int:
        cut = max(text.rfind("\n"), text.rfind("\r"))
        if cut >= 0:
            column, text = 0, text[cut + 1 :]
        for i, part in enumerate(text.split("\t")):
            if i:
                column += TAB - column % TAB
            column += len(part.encode())
        return column

    def entity(text: str) -> str:
        return text.replace("&", "&amp;").replace("'", "&apos;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")

    def document(nodes: Iterator[tuple]) -> str | None:
        out, column = [], 0
        open_: list[tuple] = []

        def put(text: str) -> None:
            nonlocal column
            out.append(text)
            column = advance(text, column)

        def escaped(text: str) -> None:
            nonlocal column
            out.append(entity(text))
            column = advance(text, column)  # an entity is as wide as what it stands for

        def space(place: str, kind: str, name: str | None, attrs: list, depth: int, leaf: bool) -> None:
            if options.whitespace and (s := options.whitespace(Written(kind, name, dict(attrs), depth, leaf), place)):
                put(s)

        def gap() -> None:
            put("\n" if 0 < options.wrap < column else " ")

        def close(name: str, attrs: list, depth: int) -> None:
            space("before_close", "ELEMENT", name, attrs, depth, False)
            put("</"), escaped(name), put(">")
            space("after_close", "ELEMENT", name, attrs, depth, False)

        for at, last, depth, place, kind, name, text, whole, number, custom, ws, attrs in nodes:
            while open_ and open_[-1][0] < at:
                close(*open_.pop()[1:])
            leaf = last == at
            if kind == "ELEMENT":
                space("before_open", kind, name, attrs, depth, leaf)
                put("<"), escaped(name)
                for key, value in attrs:
                    width = len(key.encode()) + (len(value.encode()) + 3 if value is not None else 0)
                    put("\n" if 0 < options.wrap < column + width else " ")
                    escaped(key)
                    if value is not None:
                        put('="'), escaped(value), put('"')
                put("/>" if leaf else ">")
                space("after_open", kind, name, attrs, depth, leaf)
                if not leaf:
                    open_.append((last, name, attrs, depth))
            elif kind in ("CDATA", "COMMENT", "DECLARATION", "DIRECTIVE"):
                before, after = {"CDATA": ("<![CDATA[", "]]>"), "COMMENT": ("<!--", "-->"), "DECLARATION": ("<!", ">"), "DIRECTIVE": ("<?", "?>")}[kind]
                space("before_open", kind, None, attrs, depth, leaf)
                put(before + text + after)
                space("after_open", kind, None, attrs, depth, leaf)
            elif kind in ("INTEGER", "REAL"):
                if place > 0:
                    gap()
                escaped(str(whole) if kind == "INTEGER" else "%g" % number)  # six digits, as C writes them
            elif kind == "CUSTOM":
                saved = options.custom_save(custom) if options.custom_save else None
                if saved is None:
                    return None
                escaped(saved)
            else:
                if kind == "TEXT" and ws and column > 0:
                    gap()
                escaped(text)
        while open_:
            close(*open_.pop()[1:])
        return "".join(out)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch["tokens"]
            fields = tokens.flatten()
            pairs = fields.field("attrs")
            each = pairs.flatten()
            attrs = iter(zip(each.field("name").to_pylist(), each.field("value").to_pylist()))
            attrs = [[next(attrs) for _ in range(n or 0)] for n in pairs.value_lengths().to_pylist()]
            nodes = zip(*(fields.field(f).to_pylist() for f in NODE_FIELDS), attrs)
            made = [document(islice(nodes, n)) for n in tokens.value_lengths().to_pylist()]
            yield pa.record_batch([batch["doc_id"], pa.array(made, pa.string())], names=["doc_id", "xml"])

    return document, rows


#: Characters that markup replaces, and line breaks, which the column for wrapping and blanks depends on.
_MARKUP, _BREAKS = np.zeros(256, bool), np.zeros(256, bool)
_MARKUP[list(b"&'<>\"")] = _BREAKS[[10, 13]] = True
_BEFORE = {"ELEMENT": "<", "CDATA": "<![CDATA[", "COMMENT": "<!--", "DECLARATION": "<!", "DIRECTIVE": "<?"}
_AFTER = {"CDATA": "]]>", "COMMENT": "-->", "DECLARATION": ">", "DIRECTIVE": "?>"}


def _bytes(strings: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of strings without nulls one after the other, and where each begins and the last one ends."""
    ends = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset :][: len(strings) + 1].astype(np.int64)
    held = strings.buffers()[2]
    data = np.frombuffer(held, np.uint8)[ends[0] : ends[-1]] if held is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return data, ends - ends[0]


def _cut(strings: pa.StringArray, at: np.ndarray) -> pa.StringArray:
    """Strings without nulls joined to one for each stretch between two of the places `at`."""
    data, ends = _bytes(strings)
    return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(ends[at].astype(np.int32)), pa.py_buffer(data))


def _entities(strings: pa.StringArray) -> pa.StringArray:
    if _MARKUP[_bytes(strings)[0]].any():
        for plain, entity in (("&", "&amp;"), ("'", "&apos;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            strings = pc.replace_substring(strings, plain, entity)
    return strings


def flowing(n: Nodes, options: SaveOptions) -> np.ndarray:
    """The trees that flow_of() takes: those without line breaks, custom values and a value as their root; none if there are wrapping or functions."""
    if options.wrap > 0 or options.whitespace or not len(n):
        return np.zeros(len(n.first), bool)
    kinds = n.columns["node_type"]
    ok = pc.is_in(kinds.take(pa.array(n.first)), pa.array(list(_BEFORE))).to_numpy(zero_copy_only=False)
    ok[n.tree[pc.equal(kinds, "CUSTOM").to_numpy(zero_copy_only=False)]] = False
    pairs = n.columns["attrs"]
    of_pair = n.tree[pc.list_parent_indices(pairs).to_numpy()]
    for strings, of in ((n.columns["name"], n.tree), (n.columns["str_value"], n.tree), *((pairs.flatten().field(i), of_pair) for i in (0, 1))):
        data, ends = _bytes(pc.fill_null(strings, ""))
        ok[of[np.searchsorted(ends, np.flatnonzero(_BREAKS[data]), "right") - 1]] = False
    return ok


def flow_of(n: Nodes) -> pa.StringArray:
    """The texts of trees that are flowing(), by arrays: tags and values are strings, put in order and joined where they lie."""
    kinds, leaf = n.columns["node_type"], n.end == np.arange(len(n))
    element = pc.equal(kinds, "ELEMENT").to_numpy(zero_copy_only=False)
    name, pairs = _entities(pc.fill_null(n.columns["name"], "")), n.columns["attrs"]
    flat = pairs.flatten()
    value = flat.field("value")
    held = pc.binary_join_element_wise('="', _entities(pc.fill_null(value, "")), '"', "")
    each = pc.binary_join_element_wise(" ", _entities(pc.fill_null(flat.field("name"), "")), pc.if_else(value.is_valid(), held, ""), "")
    attrs = _cut(each, np.concatenate([[0], np.cumsum(pc.fill_null(pairs.value_lengths(), 0).to_numpy())]))
    text = pc.fill_null(n.columns["str_value"], "")
    marked = pc.is_in(kinds, pa.array(list(_AFTER))).to_numpy(zero_copy_only=False)
    body = pc.if_else(pa.array(marked), text, _entities(text))
    number = pc.is_in(kinds, pa.array(["INTEGER", "REAL"])).to_numpy(zero_copy_only=False)
    if number.any():
        real = pc.equal(kinds, "REAL").to_numpy(zero_copy_only=False)
        said = np.flatnonzero(real)
        where = np.zeros(len(n), np.int64)
        where[said] = np.arange(len(said))
        reals = pa.array(["%g" % x for x in n.columns["real_value"].take(pa.array(said)).to_pylist()], pa.string()).take(pa.array(where, mask=~real))
        body = pc.if_else(pa.array(number), pc.if_else(pa.array(real), reals, n.columns["int_value"].cast(pa.string())), body)
    gap = number & (n.column("ord") > 0) | pc.fill_null(pc.and_(pc.equal(kinds, "TEXT"), n.columns["ws"]), False).to_numpy(zero_copy_only=False)
    around = lambda by, other: pc.fill_null(pa.array(list(by.values())).take(pc.index_in(kinds, pa.array(list(by)))), other)
    before = pc.if_else(pa.array(gap), " ", around(_BEFORE, ""))
    after = pc.if_else(pa.array(element), pc.if_else(pa.array(leaf), "/>", ">"), around(_AFTER, ""))
    opens = pc.binary_join_element_wise(before, pc.if_else(pa.array(element), name, body), attrs, after, "")
    shut = np.flatnonzero(element & ~leaf)
    shut = shut[np.lexsort((-shut, n.end[shut]))]
    ends = n.end[shut]
    order = np.empty(len(n) + len(shut), np.int64)
    order[np.arange(len(n)) + np.searchsorted(ends, np.arange(len(n)), "left")] = np.arange(len(n))
    order[ends + 1 + np.arange(len(shut))] = len(n) + np.arange(len(shut))
    closes = pc.binary_join_element_wise("</", name.take(pa.array(shut)), ">", "")
    begins = np.append(n.first, len(n))
    return _cut(pa.concat_arrays([opens, closes]).take(pa.array(order)), begins + np.searchsorted(ends, begins, "left"))


def texts_of(n: Nodes, options: SaveOptions) -> list[tuple[np.ndarray, pa.StringArray]]:
    """The trees' texts, by arrays or node by node: the trees' numbers, and their texts."""
    fast = flowing(n, options)
    out = []
    for trees, some in ((np.flatnonzero(fast), fast), (np.flatnonzero(~fast), ~fast)):
        if len(trees):
            part = n if some.all() else n.taken(np.flatnonzero(some[n.tree]))
            if some is fast:
                out.append((trees, flow_of(part)))
                continue
            fields = zip(*(part.columns[f].to_pylist() for f in NODE_FIELDS), ([(a["name"], a["value"]) for a in x or ()] for x in part.columns["attrs"].to_pylist()))
            document = _flow(options)[0]
            out.append((trees, pa.array([document(islice(fields, size)) for size in part.size.tolist()], pa.string())))
    return out


#: What saving looks at, the rank first.
NODE_FIELDS = ("node_id", "last_desc", "depth", "ord", "node_type", "name", "str_value", "int_value", "real_value", "custom", "ws")


def to_documents(nodes: DataFrame, options: SaveOptions | None = None) -> DataFrame:
    """doc_id, xml: each document's text, without a final newline. null if it has a CUSTOM value that can't be saved.

    nodes: a node table, or a subtree of it (the least node_id of a doc_id is written with all below). options None: no
    wrapping. One shuffle by doc_id, a row a node; a document is a row of the result, so its nodes meet in one task. Nodes of one
    doc_id are one document: where ids may repeat, load with ids="number" (sources.xml).
    """
    options = options or SaveOptions(wrap=0)
    gathered = nodes.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*NODE_FIELDS, "attrs"))).alias("tokens"))
    return gathered.mapInArrow(_flow(options)[1], "doc_id string, xml string")


def saved_string(documents: DataFrame, room: int) -> DataFrame:
    """doc_id, size, buffer (binary): what a buffer of `room` bytes takes, its last byte kept for the end; size is 0 if that isn't all."""
    n, data = F.octet_length("xml"), F.encode("xml", "UTF-8")
    return documents.select("doc_id", F.when(n < room, n).otherwise(0).cast("long").alias("size"), F.substring(data, 1, room - 1).alias("buffer"))


def saved_size(documents: DataFrame, room: int) -> DataFrame:
    """doc_id, size: saved_string() without the buffer."""
    return saved_string(documents, room).drop("buffer")


def to_pieces(documents: DataFrame, size: int) -> DataFrame:
    """doc_id, seq, data (binary): each document's bytes in pieces of a size, numbered from 0, as calls of a write callback take them."""
    data = F.encode("xml", "UTF-8")
    starts = F.sequence(F.lit(0), F.floor((F.greatest(F.octet_length("xml"), F.lit(1)) - 1) / size).cast("int"))
    cut = documents.filter("xml is not null").select("doc_id", data.alias("_data"), F.explode(starts).alias("seq"))
    return cut.select("doc_id", "seq", F.expr(f"substring(_data, seq * {int(size)} + 1, {int(size)})").alias("data"))


def save_io(documents: DataFrame, callback: Callable[[str, bytes], None], size: int = 1 << 16) -> None:
    """Give every document to a callback (doc_id, piece of bytes), piece after piece, where the document is. A lost task's documents are given again."""

    def each(rows: Iterator) -> None:
        for row in rows:
            data = row["xml"].encode()
            for at in range(0, len(data), size):
                callback(row["doc_id"], data[at : at + size])

    documents.filter("xml is not null").foreachPartition(each)


def file_name(doc_id: str) -> str:
    """The file that a document goes to: its id with all but letters, digits and _.-~ percent-encoded."""
    return quote(doc_id, safe="") + ".xml"


class XmlSink(DataSource):
    """df.write.format("sylva_xml_files").save(path): rows (doc_id, xml) to one file a document, each with a final newline; df.writeStream, too.

    The path is any that pyarrow's file systems know. Tasks write into a hidden folder of the write and leave a list of their files there; the commit
    moves the listed files to their places, so nothing is seen of a write that fails, nor of tasks that ran twice, and an abort removes
    the folder. A stream's epoch leaves a mark; an epoch that is given again is dropped. Rows with null xml give no file.
    """

    @classmethod
    def name(cls) -> str:
        return "sylva_xml_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _XmlWriter(self.options["path"])

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        # The process that commits makes a writer of its own, so the folder's name must follow from the query.
        return _XmlStreamWriter(self.options["path"], xxhash.xxh3_128_hexdigest(self.options.get("checkpointLocation", "")))


@dataclass
class _Staged(WriterCommitMessage):
    """The name of a task's list of files, a line `staged name`, tab between."""

    listed: str


class _Staging:
    """A hidden folder below the path that one write's tasks fill."""

    def __init__(self, path: str, name: str | None = None):
        self.path, self.name = path, f".staging-{name or uuid4().hex}"

    def _open(self):  # noqa: ANN202
        from pyarrow.fs import FileSystem

        where = self.path.replace("file:/", "file:///", 1) if self.path.startswith("file:/") and not self.path.startswith("file://") else self.path
        return FileSystem.from_uri(where)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = self._open()
        fs.create_dir(f"{root}/{self.name}", recursive=True)
        files, listed = [], uuid4().hex
        for batch in iterator:
            for doc_id, xml in zip(batch["doc_id"].to_pylist(), batch["xml"].to_pylist()):
                if xml is not None:
                    files.append(f"{uuid4().hex}\t{file_name(doc_id)}\n")
                    with fs.open_output_stream(f"{root}/{self.name}/{files[-1][:32]}") as out:
                        out.write((xml if xml.endswith("\n") else xml + "\n").encode())
        with fs.open_output_stream(f"{root}/{self.name}/{listed}") as out:
            out.write("".join(files).encode())
        return _Staged(listed)

    def publish(self, messages: list[WriterCommitMessage | None]) -> None:
        """Move the listed files to their places, several at a time, list after list."""
        fs, root = self._open()
        fs.create_dir(root, recursive=True)
        with ThreadPoolExecutor(16) as pool:
            for message in filter(None, messages):
                with fs.open_input_stream(f"{root}/{self.name}/{message.listed}") as f:
                    pairs = [line.split("\t") for line in f.read().decode().splitlines()]
                list(pool.map(lambda pair: fs.move(f"{root}/{self.name}/{pair[0]}", f"{root}/{pair[1]}"), pairs))
        self.clear()

    def clear(self, tries: int = 8) -> None:
        """Delete the folder. Tasks of a failed write may still put files there while they are being killed, so it is looked at again a while."""
        from pyarrow.fs import FileType

        fs, root = self._open()
        for i in range(tries):
            if fs.get_file_info(f"{root}/{self.name}").type == FileType.NotFound:
                return
            try:
                fs.delete_dir(f"{root}/{self.name}")
            except OSError:
                if i == tries - 1:
                    raise
            time.sleep(0.1 * 2**i if i else 0)


class _XmlWriter(_Staging, DataSourceArrowWriter):
    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        self.publish(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self.clear()


class _XmlStreamWriter(_Staging, DataSourceStreamArrowWriter):
    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        from pyarrow.fs import FileType

        fs, root = self._open()
        mark = f"{root}/.epochs/{batchId}"
        if fs.get_file_info(mark).type != FileType.NotFound:
            return self.clear()
        self.publish(messages)
        fs.create_dir(f"{root}/.epochs", recursive=True)
        with fs.open_output_stream(mark):
            pass

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        self.clear()


def write_files(documents: DataFrame, path: str) -> None:
    """Each document to a file of its own below path, named by file_name(doc_id), with a final newline."""
    documents.sparkSession.dataSource.register(XmlSink)
    documents.select("doc_id", "xml").write.format("sylva_xml_files").mode("append").save(path)
