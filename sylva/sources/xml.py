"""Loading: documents in string or binary columns, in pieces, in files, and by the Python data source `sylva_xml`, to nodes, events or errors.

Each document is scanned within one task. Documents are first spread by their id, so that the scanning, which costs far more
than moving the text, has tasks of even size whatever the layout of the table or the plan before.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import partial
from importlib import import_module
from itertools import accumulate, chain, islice, repeat
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sylva.functions.columns import passed, plain_columns, said, slices
from sylva.functions.scan import Event, Scanner, clean, decode, nodes, plain_rows
from sylva.functions.schema import ERROR, EVENT, KEPT, NODE, PARTS, SAVED, SCANNED, LoadOptions, SaveOptions, Seen, Watch
from sylva.operators import edit
from sylva.operators.find import path_steps
from sylva.operators.whole import PICKED, PLACES, Nodes, Step
from sylva.sources.save import texts_of

ROWS = 20_000
_TYPE, _NAME = NODE.fieldNames().index("node_type"), NODE.fieldNames().index("name")


def _scanner(value: str | bytes, options: LoadOptions | None, sax: bool, top: tuple[str, dict] | None = None) -> Scanner:
    text, wrong = clean(value) if isinstance(value, str) else decode(bytes(value))
    return Scanner(text, options, wrong, sax, top)


def node_rows(doc_id: str, value: str | bytes, options: LoadOptions | None, top: tuple[str, dict] | None = None) -> Sequence[Sequence]:
    text, wrong = clean(value) if isinstance(value, str) else decode(bytes(value))
    if wrong is None and (plain := plain_rows(doc_id, text, options or LoadOptions(None), top)) is not None:
        return plain
    s = Scanner(text, options, wrong, False, top)
    rows = nodes(s, under=top is not None)
    return () if any(fatal for _, _, fatal in s.errors) else [(doc_id, *row, None) for row in rows]


def event_rows(doc_id: str, value: str | bytes, options: LoadOptions | None, top: tuple[str, dict] | None = None) -> Iterator[tuple]:
    depth = 0
    for seq, e in enumerate(_scanner(value, options, True, top)):
        depth -= e.event == "ELEMENT_CLOSE"
        yield (doc_id, seq, e.event, depth, *e[1:])
        depth += e.event == "ELEMENT_OPEN"


def _watched(s: Scanner, watch: Watch) -> Iterator[tuple[Event, int, int, int | None, bool]]:
    """Event, seq, depth, the kept parent's seq and whether the event is kept, up to the stop."""
    open_: list[tuple[str, dict]] = []
    kept: list[int | None] = []
    none: dict[str, str] = {}
    for seq, e in enumerate(s):
        close = e.event == "ELEMENT_CLOSE"
        own = kept.pop() if close else None
        if close:
            open_.pop()
        value = e.str_value if e.str_value is not None else e.int_value if e.int_value is not None else e.real_value if e.real_value is not None else e.custom
        seen = Seen(e.event, e.node_type, e.name, dict(e.attrs) if e.attrs else none, value, open_, bool(kept) and kept[-1] is not None)
        keep = watch.keep is None or watch.keep(seen)
        yield e, seq, len(open_), own if close else kept[-1] if kept else None, keep
        if watch.stop and watch.stop(seen):
            return
        if e.event == "ELEMENT_OPEN":
            open_.append((e.name, seen.attrs))
            kept.append(seq if keep else None)


def kept_rows(watch: Watch):
    def rows(doc_id: str, value: str | bytes, options: LoadOptions | None, top: tuple[str, dict] | None = None) -> Iterator[tuple]:
        for e, seq, depth, parent, keep in _watched(_scanner(value, options, True, top), watch):
            if keep:
                yield (doc_id, seq, parent, e.event, depth, *e[1:])

    return rows


def _kept_of(ids: list[str], doc: list[int], made: dict[str, pa.Array], watch: Watch) -> Iterator[tuple]:
    """What kept_rows() gives of plain documents, from their nodes: an element closes before the first node behind it."""
    plain = lambda c: made[c].to_numpy(zero_copy_only=False).tolist()
    number = lambda c: [v if is_ else None for v, is_ in zip(made[c].fill_null(0).to_numpy().tolist(), made[c].is_valid().to_numpy(zero_copy_only=False).tolist())]
    ends, pairs = made["attrs"].offsets.to_numpy().tolist(), list(zip(*(said(made["attrs"].values.field(i)) for i in (0, 1))))
    keep, none, open_, kept, lasts, names = watch.keep, {}, [], [], [], []
    seq, now = 0, ""

    def close() -> Iterator[tuple]:
        nonlocal seq
        own, name = kept.pop(), names.pop()
        open_.pop(), lasts.pop()
        if keep is None or keep(Seen("ELEMENT_CLOSE", "ELEMENT", name, none, None, open_, bool(kept) and kept[-1] is not None)):
            yield (now, seq, own, "ELEMENT_CLOSE", len(open_), "ELEMENT", name, None, None, None, None, None, None)
        seq += 1

    nodes = zip(doc, plain("node_id"), plain("last_desc"), said(made["node_type"]), said(made["name"]), said(made["str_value"]), number("int_value"), number("real_value"), made["ws"].to_pylist())
    for i, (of, node, last, kind, name, text, whole, real, ws) in enumerate(nodes):
        while lasts and (node == 0 or lasts[-1] < node):
            yield from close()
        if node == 0:
            seq, now = 0, ids[of]
        inside = bool(kept) and kept[-1] is not None
        if kind == "ELEMENT":
            attrs = pairs[ends[i] : ends[i + 1]]
            seen = Seen("ELEMENT_OPEN", kind, name, dict(attrs) if attrs else none, None, open_, inside)
        else:
            attrs, seen = None, Seen("DIRECTIVE" if kind == "DIRECTIVE" else "DATA", kind, None, none, text if text is not None else whole if whole is not None else real, open_, inside)
        if hit := keep is None or keep(seen):
            yield (now, seq, kept[-1] if kept else None, seen.event, len(open_), kind, name, attrs, text, whole, real, ws, None)
        if kind == "ELEMENT":
            open_.append((name, seen.attrs)), kept.append(seq if hit else None), lasts.append(last), names.append(name)
        seq += 1
    while lasts:
        yield from close()


def _kept_by_slice(watch: Watch, schema: StructType, options: LoadOptions | None):
    """As _by_row(kept_rows(watch)), without a stop: the plain documents of some MB of strings from their nodes, the others by row."""
    kinds = {f.name: f.type for f in to_arrow_schema(NODE) if f.name in ("node_id", "last_desc", "node_type", "name", "attrs", "str_value", "int_value", "real_value", "ws")}
    by_row, make = _by_row(kept_rows(watch), schema, options), _batch(schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.column(1).type != pa.string() or batch.num_columns > 2:
                yield from by_row([batch])
                continue
            for part in slices(batch, 1):
                plain, doc, made = plain_columns(part.column(1), options or LoadOptions(None), kinds, ignored=False)
                if len(doc):
                    held = _kept_of(part.column(0).to_pylist(), doc.tolist(), made, watch)
                    while some := list(islice(held, ROWS)):
                        yield make(some)
                if not plain.all():
                    yield from by_row([part.filter(pa.array(~plain))])

    return rows


def scanned_rows(watch: Watch):
    def rows(doc_id: str, value: str | bytes, options: LoadOptions | None, top: tuple[str, dict] | None = None) -> Iterator[tuple]:
        s = _scanner(value, options, True, top)
        n_events = n_nodes = n_kept = 0
        stopped = False

        def stop(seen: Seen) -> bool:
            nonlocal stopped
            stopped = bool(watch.stop and watch.stop(seen))
            return stopped

        for e, _, _, _, keep in _watched(s, Watch(watch.keep, stop)):
            n_events += 1
            n_nodes += e.node_type is not None and e.event != "ELEMENT_CLOSE"
            n_kept += keep
        failed = any(fatal for _, _, fatal in s.errors)
        yield doc_id, n_events, n_nodes, n_kept, s.at if stopped or failed else len(s.text), len(s.text), stopped, failed

    return rows


def error_rows(doc_id: str, value: str | bytes, options: LoadOptions | None, top: tuple[str, dict] | None = None) -> Iterator[tuple]:
    s = _scanner(value, options, False, top)
    for _ in s:
        pass
    for line, message, fatal in s.errors:
        yield doc_id, line, message, fatal


def _batches(rows: Iterator[tuple], schema: StructType) -> Iterator[pa.RecordBatch]:
    """Arrow batches of the columns of rows that the schema has; each of its fields tells its place in a row."""
    make = _batch(schema)
    while some := list(islice(rows, ROWS)):
        yield make(some)


def _batch(schema: StructType) -> Callable[[list], pa.RecordBatch]:
    arrow = to_arrow_schema(schema)
    places = [itemgetter(f.metadata["place"] if "place" in (f.metadata or {}) else i) for i, f in enumerate(schema)]
    return lambda some: pa.record_batch([(_pairs if f.name == "attrs" else pa.array)(list(map(p, some)), f.type) for p, f in zip(places, arrow)], schema=arrow)


def _pairs(lists: list[list[tuple[str, str]] | None], kind: pa.DataType) -> pa.Array:
    """Attributes, column by column, which is much faster than pair by pair."""
    ends = list(accumulate(len(x) if x else 0 for x in lists))
    starts = [None if x is None else end - len(x) for x, end in zip(lists, ends)]
    flat = list(chain.from_iterable(filter(None, lists)))
    each = pa.StructArray.from_arrays([pa.array([p[i] for p in flat], pa.string()) for i in (0, 1)], fields=list(kind.value_type))
    return pa.ListArray.from_arrays(pa.array([*starts, len(flat)], pa.int32()), each, type=kind)


def _of(schema: StructType, columns: Sequence[str] | None) -> StructType:
    """The schema with the columns asked for, each with its place among all."""
    fields = StructType()
    for name in columns or schema.fieldNames():
        fields = fields.add(name, schema[name].dataType, True, {"place": schema.fieldNames().index(name)})
    return fields


def _by_row(make: Callable, schema: StructType, options: LoadOptions | None, elements: frozenset[str] | None = None):
    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterable]:
        for batch in batches:
            under = batch.schema.names[2:]
            for i, (doc_id, value) in enumerate(zip(batch.column(0), batch.column(1))):
                value = value.as_py()
                if value is None:
                    continue
                top = (batch["name"][i].as_py(), {a["name"]: a["value"] for a in batch["attrs"][i].as_py() or []}) if under else None
                made = make(doc_id.as_py(), value, options, top)
                yield made if elements is None else [row for row in made if row[_TYPE] == "ELEMENT" and row[_NAME] in elements]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows are many, live shortly and make no cycles, so the collector looks for some less often.
        gc.set_threshold(200_000, 20, 20)
        batch, some = _batch(schema), []
        for made in map(iter, scanned(batches)):
            while more := list(islice(made, ROWS)):
                some += more
                if len(some) >= ROWS:
                    yield batch(some)
                    some = []
        if some:
            yield batch(some)

    return rows


def _by_slice(schema: StructType, options: LoadOptions | None, elements: frozenset[str] | None = None, paths: Sequence[Sequence[tuple[str, bool]]] | None = None):
    """As _by_row(node_rows): the plain documents of some MB of strings at once, the others by row. Of plain ones only what the paths pass, if there are any."""
    arrow = to_arrow_schema(schema)
    kinds = {f.name: f.type for f in arrow} | ({"node_type": pa.string(), "name": pa.string()} if elements is not None else {})
    kinds |= {f.name: f.type for f in to_arrow_schema(NODE) if paths is not None and f.name in ("node_id", "parent_id", "last_desc", "name")}
    by_row, names = _by_row(node_rows, schema, options, elements), None if elements is None else pa.array(sorted(elements), pa.string())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.column(1).type != pa.string() or batch.num_columns > 2:
                yield from by_row([batch])
                continue
            for part in slices(batch, 1):
                plain, doc, made = plain_columns(part.column(1), options or LoadOptions(None), kinds)
                if made or len(doc):
                    made["doc_id"] = part.column(0).take(pa.array(doc))
                    out = pa.record_batch([made[f.name].cast(f.type) if made[f.name].type != f.type else made[f.name] for f in arrow], schema=arrow)
                    keep = None if names is None else pc.and_(pc.equal(made["node_type"], "ELEMENT"), pc.is_in(made["name"], names))
                    if paths is not None:
                        led = pa.array(passed(made, paths))
                        keep = led if keep is None else pc.and_(keep, led)
                    yield out if keep is None else out.filter(keep)
                if not plain.all():
                    yield from by_row([part.filter(pa.array(~plain))])

    return rows


def _nodes_of(batches: Iterator[pa.RecordBatch], options: LoadOptions | None, columns: frozenset[str], steps: Sequence[Step]) -> Iterator[tuple[pa.Array, Nodes]]:
    """doc_ids, and the nodes of their documents after the steps, some MB of texts at a time: plain ones by arrays, the others by row."""
    kinds, make = {f.name: f.type for f in to_arrow_schema(NODE) if f.name in columns}, _batch(NODE)

    def by_row(ids: pa.Array, values: pa.Array, which: Iterable[int]) -> Iterator[Nodes]:
        some, doc = [], []
        for i in which:
            if values[i].is_valid:
                rows = sorted(node_rows(ids[i].as_py(), values[i].as_py(), options), key=itemgetter(1))
                some += rows
                doc += repeat(i, len(rows))
            if len(some) >= ROWS:
                yield Nodes(np.array(doc), {c: x for c, x in zip(NODE.fieldNames(), make(some).columns) if c in columns})
                some, doc = [], []
        if some:
            yield Nodes(np.array(doc), {c: x for c, x in zip(NODE.fieldNames(), make(some).columns) if c in columns})

    def given(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, Nodes]]:
        if batch.column(1).type != pa.string():
            yield from zip(repeat(batch.column(0)), by_row(batch.column(0), batch.column(1), range(batch.num_rows)))
            return
        for part in slices(batch, 1):
            plain, doc, made = plain_columns(part.column(1), options or LoadOptions(None), kinds)
            if len(doc):
                yield part.column(0), Nodes(doc, made)
            if not plain.all():
                yield from zip(repeat(part.column(0)), by_row(part.column(0), part.column(1), np.flatnonzero(~plain).tolist()))

    for batch in batches:
        for ids, n in given(batch):
            for step in steps:
                n = step(n)
            yield ids, n


def _stepped(schema: StructType, options: LoadOptions | None, elements: frozenset[str] | None, paths: Sequence[Sequence[tuple[str, bool]]] | None, steps: Sequence[Step]):
    """As _by_slice(), of what the steps leave."""
    arrow, names = to_arrow_schema(schema), None if elements is None else pa.array(sorted(elements), pa.string())
    columns = frozenset({*PLACES, *PICKED, *(f.name for f in arrow)})

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, n in _nodes_of(batches, options, columns, steps):
            if not len(n):
                continue
            keep = np.ones(len(n), bool) if names is None else pc.and_(pc.equal(n.columns["node_type"], "ELEMENT"), pc.is_in(n.columns["name"], names)).to_numpy(zero_copy_only=False)
            if paths is not None:
                keep = keep & passed(n.columns, paths)
            at = pa.array(np.flatnonzero(keep))
            held = {"doc_id": lambda: ids.take(pa.array(n.doc[keep])), "part": lambda: pa.array(n.part[keep])}
            yield pa.record_batch([(held[f.name]() if f.name in held else n.columns[f.name].take(at)).cast(f.type) for f in arrow], schema=arrow)

    return rows


#: Parts a repeated id from its number. Within ids it is doubled, so no made id is also a given one.
SEPARATOR = "\x1f"
IDS = ("unique", "number", "reject")


def _repeated(given: DataFrame) -> DataFrame:
    """The ids that several rows have, each once. Only ids are shuffled, counted before that."""
    return given.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_n")).filter("_n > 1").select("doc_id", F.lit(True).alias("_again"))


def _told_apart(given: DataFrame) -> DataFrame:
    again = given.join(_repeated(given), "doc_id", "left")
    number = F.concat(F.lit(SEPARATOR), F.monotonically_increasing_id().cast("string"))
    own = F.replace(F.coalesce("doc_id", F.lit("")), F.lit(SEPARATOR), F.lit(2 * SEPARATOR))
    return again.withColumn("doc_id", F.when(F.col("_again") | F.col("doc_id").isNull(), F.concat(own, number)).otherwise(own)).drop("_again")


def with_unique_ids(docs: DataFrame, doc_id: str | Column = "doc_id") -> DataFrame:
    """docs with a doc_id (string) of its own for each row: what it was, or, for null and repeated ones, that, SEPARATOR and a number.

    The numbers follow the rows' places in the partitions of docs and mean nothing else; write the table if they are to last. SEPARATOR within
    an id is doubled. A repeated id with a third of all rows is shuffled once, already counted; no rows of one id meet.
    """
    given = docs.withColumn("doc_id", (F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"))
    return _told_apart(given).select(*given.columns)


def _load(docs: DataFrame, column: str | Column, doc_id: str | Column, make: Callable, schema: StructType, options: LoadOptions | None, columns: Sequence[str] | None = None, elements: Sequence[str] | None = None, spread: bool = True, more: Sequence[str] = (), ids: str = "unique", run: Callable | None = None) -> DataFrame:
    doc, value = (F.col(c) if isinstance(c, str) else c for c in (doc_id, column))
    given = docs.select(doc.cast("string").alias("doc_id"), value.alias("value"), *more)
    if ids not in IDS:
        raise ValueError(f"ids: one of {IDS}")
    if ids == "number":
        given = _told_apart(given)
    elif ids == "reject":
        given = given.join(_repeated(given), "doc_id", "left_anti")
    given = given.filter("doc_id is not null")
    if spread and not docs.isStreaming:
        given = given.hint("rebalance", "doc_id")
    schema = _of(schema, columns)
    plain = StructType([type(f)(f.name, f.dataType) for f in schema])
    only = None if elements is None else frozenset(elements)
    run = run(schema, options) if run else _by_slice(schema, options, only) if make is node_rows else _by_row(make, schema, options, only)
    return given.mapInArrow(run, plain)


def shred(docs: DataFrame, column: str | Column = "xml", doc_id: str | Column = "doc_id", options: LoadOptions | None = LoadOptions(), columns: Sequence[str] | None = None, elements: Sequence[str] | None = None, spread: bool = True, ids: str = "unique", paths: Sequence[str] | None = None, steps: Sequence[Step] = ()) -> DataFrame:
    """The node table of the documents in a string or binary column. Null and empty documents have no nodes, nor has one whose
    load fails: load_errors() tells why. options None: values are TEXT, but ignored before the first tag.

    Everything on node tables goes by doc_id, so rows must not share one. ids: `unique`, the default, takes them as they are: the caller knows that
    none is repeated. `number` gives rows of a null or repeated doc_id ids of their own (with_unique_ids()), so each row is a document; `reject` leaves
    out all rows of a repeated one. Without `number`, rows without doc_id are left out, too; load_errors() lists what is left out. Both read docs twice.

    columns: only these columns of the node table are made. elements: only elements of these names are given out, with the
    ranks that they have among all nodes. spread: deal the documents out by doc_id first; without it they are scanned where they are.
    paths: for find_path() or find_paths() of these paths from the root: nodes that none of them passes may be left out, which they
    are of plain documents (functions.columns). Ranks stay as they are among all nodes.
    steps: done one after the other on each document before nodes are given out (operators.whole); columns may name `part` then, which steps set.
    """
    if steps:
        only, led = None if elements is None else frozenset(elements), None if paths is None else [path_steps(p) for p in paths]
        return _load(docs, column, doc_id, node_rows, PARTS if columns else NODE, options, columns, spread=spread, ids=ids, run=lambda schema, options: _stepped(schema, options, only, led, steps))
    run = None if paths is None else lambda schema, options: _by_slice(schema, options, None if elements is None else frozenset(elements), [path_steps(p) for p in paths])
    return _load(docs, column, doc_id, node_rows, NODE, options, columns, elements, spread, ids=ids, run=run)


def saved(docs: DataFrame, column: str | Column = "xml", doc_id: str | Column = "doc_id", options: LoadOptions | None = LoadOptions(), save: SaveOptions | None = None, spread: bool = True, ids: str = "unique", steps: Sequence[Step] = ()) -> DataFrame:
    """doc_id, xml: what to_documents() gives of shred()'s node table after the steps (a row a tree, where these make several), without a shuffle of nodes: a
    document is loaded, changed and saved within a task. Failed loads give no row; null and repeated doc_ids as in shred()."""
    save = save or SaveOptions(wrap=0)
    columns = frozenset(f for f in NODE.fieldNames() if f not in ("doc_id", "user_data"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, n in _nodes_of(batches, options, columns, steps):
            for trees, made in texts_of(n, save) if len(n) else ():
                yield pa.record_batch([doc_ids.take(pa.array(n.doc[n.first[trees]])), made], names=["doc_id", "xml"])

    return _load(docs, column, doc_id, node_rows, SAVED, options, spread=spread, ids=ids, run=lambda schema, options: rows)


def events(docs: DataFrame, column: str | Column = "xml", doc_id: str | Column = "doc_id", options: LoadOptions | None = LoadOptions(), columns: Sequence[str] | None = None, spread: bool = True, ids: str = "unique") -> DataFrame:
    """The event table (or these columns of it): what an event callback would see, up to the failure of a load that fails. Works on streams, too.
    Null and repeated doc_ids as in shred()."""
    return _load(docs, column, doc_id, event_rows, EVENT, options, columns, spread=spread, ids=ids)


def kept_events(docs: DataFrame, watch: Watch, column: str | Column = "xml", doc_id: str | Column = "doc_id", options: LoadOptions | None = LoadOptions(), columns: Sequence[str] | None = None, spread: bool = True, ids: str = "unique") -> DataFrame:
    """What callbacks retain of a load: the events that watch keeps, with the seq of the kept element that each lies directly in (null if that isn't
    kept; of a closing tag, its own element's). Nothing else leaves the scanner, and a document is scanned no further than to its stop, so what would be
    wrong after that isn't noticed. A failed load gives what it kept before. Null and empty documents keep nothing; null and repeated doc_ids as in shred(). Streams, too."""
    run = None if watch.stop else partial(_kept_by_slice, watch)
    return _load(docs, column, doc_id, kept_rows(watch), KEPT, options, columns, spread=spread, ids=ids, run=run)


def scanned(docs: DataFrame, watch: Watch, column: str | Column = "xml", doc_id: str | Column = "doc_id", options: LoadOptions | None = LoadOptions(), columns: Sequence[str] | None = None, spread: bool = True, ids: str = "unique") -> DataFrame:
    """One row a document that isn't null: the events and nodes seen and the events kept, where the scan ended (at; characters, up to the value or tag that ended it)
    and how long the text is up to its first broken character, and whether it was stopped or failed. Null and repeated doc_ids as in shred()."""
    return _load(docs, column, doc_id, scanned_rows(watch), SCANNED, options, columns, spread=spread, ids=ids)


def load_errors(docs: DataFrame, column: str | Column = "xml", doc_id: str | Column = "doc_id", options: LoadOptions | None = LoadOptions(), spread: bool = True, ids: str = "unique") -> DataFrame:
    """doc_id, line, message, fatal; a load may fail with an empty message. Not fatal: the nodes up to there count.

    Rows that shred() leaves out for their doc_id have line 0: each of a null one, and with ids `reject` each of a repeated one.
    """
    errors = _load(docs, column, doc_id, error_rows, ERROR, options, spread=spread, ids=ids)
    given = docs.select((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string").alias("doc_id"))
    left_out = lambda rows, message: rows.select("doc_id", F.lit(0).cast("long").alias("line"), F.lit(message).alias("message"), F.lit(True).alias("fatal"))
    if ids != "number":
        errors = errors.unionByName(left_out(given.filter("doc_id is null"), "A document without id"))
    if ids == "reject":
        errors = errors.unionByName(left_out(given.join(_repeated(given), "doc_id", "left_semi"), "Several documents with this id"))
    return errors


def load_under(n: DataFrame, parents: DataFrame, fragments: DataFrame, column: str = "xml", options: LoadOptions | None = LoadOptions()) -> DataFrame:
    """n with each fragment (doc_id, column) loaded as the last children of its document's parent (doc_id, node_id).

    A fragment is scanned as if it stood in its parent: the parent's name and attributes tell the type of its values, it may start with a
    value and have several roots; a last value that neither white space nor a tag follows is lost. A fragment that fails adds nothing.
    """
    # A row a document on each side, which the sizes of files don't tell: never broadcast.
    of = n.join(parents.select("doc_id", "node_id").hint("merge"), ["doc_id", "node_id"]).select("doc_id", "name", "attrs")
    given = fragments.select("doc_id", column).hint("merge").join(of, "doc_id")
    made = _load(given, column, "doc_id", node_rows, NODE, options, more=("name", "attrs"))
    return edit.append(n, made, parents)


def from_pieces(pieces: DataFrame) -> DataFrame:
    """doc_id, xml (binary) of documents that come in pieces (doc_id, seq, data), as calls of a read callback would give them."""
    data = F.col("data").cast("binary")
    each = pieces.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", F.hex(data).alias("x")))).alias("all"))
    return each.select("doc_id", F.unhex(F.array_join(F.transform("all", lambda p: p["x"]), "")).alias("xml"))


def read_files(spark: SparkSession, path: str, options: LoadOptions | None = LoadOptions(), glob: str = "*") -> DataFrame:
    """The node table of all files under a path that Spark can read; doc_id is the file's path. One file is one document."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return shred(files, "content", "path", options)


def register_sql(spark: SparkSession, name: str = "shred", options: LoadOptions | None = LoadOptions()) -> None:
    """Make shredding two table functions of SQL. Rows of a null document or doc_id have no nodes.

    SELECT n.* FROM shred_table(TABLE(SELECT doc_id, xml FROM d)) n: whole tables, of two columns, by Arrow batches in both directions, as shred() does
    it. SELECT d.*, n.* FROM d, LATERAL shred(d.doc_id, d.xml) n: beside each row's other columns; row by row, as lateral joins take no Arrow functions.
    """

    class Shred:
        def eval(self, doc_id, xml):  # noqa: ANN001, ANN202
            if doc_id is not None and xml is not None:
                yield from node_rows(str(doc_id), xml, options)

    class ShredTable:
        def eval(self, docs: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            given = zip(docs.column(0).to_pylist(), docs.column(1).to_pylist())
            yield from _batches((row for doc_id, xml in given if doc_id is not None and xml is not None for row in node_rows(str(doc_id), xml, options)), NODE)

    spark.udtf.register(name, F.udtf(Shred, returnType=NODE))
    spark.udtf.register(f"{name}_table", F.arrow_udtf(ShredTable, returnType=NODE))


class XmlSource(DataSource):
    """spark.read.format("sylva_xml"), and spark.readStream: the node table of documents given by a function, as a read callback would give them.

    Options: documents, `module:function` of a function (part, parts) that gives (doc_id, bytes) pairs; parts; value_type;
    pushdown, `true` to take filters on name and node_type (spark.sql.python.filterPushdown.enabled must be set, too).

    As a stream, documents come in a fixed order and only ever get more. documents is a function (begin, end, options) of places in that order, called on
    executors and perhaps again after a failure; latest, `module:function` of (options), tells how many there are by now; done, optional, is
    told (end, options) when a batch's progress has been recorded, so that what lies before can go. start: the first place. A batch is cut into `parts` ranges of even length.
    """

    @classmethod
    def name(cls) -> str:
        return "sylva_xml"

    def schema(self) -> StructType:
        return NODE

    def reader(self, schema: StructType) -> DataSourceReader:
        return (_FilteringReader if self.options.get("pushdown") == "true" else _XmlReader)(dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _XmlStreamReader(dict(self.options))


def _function(name: str) -> Callable:
    module, _, function = name.partition(":")
    return getattr(import_module(module), function)


class _XmlReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.only = options, []

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(int(self.options.get("parts", 1)))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        options = LoadOptions(self.options.get("value_type", "TEXT"))
        documents = _function(self.options["documents"])(partition.value, int(self.options.get("parts", 1)))
        rows = (row for doc_id, data in documents for row in node_rows(doc_id, data, options))
        yield from _batches((row for row in rows if all(row[i] == value for i, value in self.only)), NODE)


class _FilteringReader(_XmlReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Nodes of one name or type are picked before they become rows."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute in (("name",), ("node_type",)):
                self.only.append((NODE.fieldNames().index(f.attribute[0]), f.value))
            else:
                yield f


class _Range(InputPartition):
    """Documents from one place up to another."""

    def __init__(self, begin: int, end: int):
        self.begin, self.end = begin, end


class _XmlStreamReader(DataSourceStreamReader):
    """An offset is the number of documents before it, so a batch is a range of places, the same ones whenever it is read again."""

    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:
        return {"at": int(self.options.get("start", 0))}

    def latestOffset(self) -> dict:
        return {"at": max(int(self.options.get("start", 0)), _function(self.options["latest"])(self.options))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        begin, n = start["at"], end["at"] - start["at"]
        parts = min(n, int(self.options.get("parts", 1)))
        return [_Range(begin + n * i // parts, begin + n * (i + 1) // parts) for i in range(parts)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        options = LoadOptions(self.options.get("value_type", "TEXT"))
        documents = _function(self.options["documents"])(partition.begin, partition.end, self.options)
        yield from _batches((row for doc_id, data in documents if data is not None for row in node_rows(doc_id, data, options)), NODE)

    def commit(self, end: dict) -> None:
        if "done" in self.options:
            _function(self.options["done"])(end["at"], self.options)
