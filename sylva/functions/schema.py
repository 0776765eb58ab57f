"""The node table, the event table and the error table, and the options of loading and saving."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import types as T

ATTRS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())]))

#: One row a node. node_id: rank in pre-order, 0 for the root; last_desc: rank of the last descendant, so that
#: b lies under a if a.node_id < b.node_id <= a.last_desc.
NODE = T.StructType([
    T.StructField("doc_id", T.StringType()), T.StructField("node_id", T.LongType()), T.StructField("parent_id", T.LongType()),
    T.StructField("last_desc", T.LongType()), T.StructField("depth", T.IntegerType()), T.StructField("ord", T.IntegerType()),
    T.StructField("node_type", T.StringType()), T.StructField("name", T.StringType()), T.StructField("attrs", ATTRS),
    T.StructField("str_value", T.StringType()), T.StructField("int_value", T.LongType()), T.StructField("real_value", T.DoubleType()),
    T.StructField("ws", T.BooleanType()), T.StructField("custom", T.StringType()), T.StructField("user_data", T.MapType(T.StringType(), T.StringType())),
])

#: One row an event, seq in order from 0.
EVENT = T.StructType([
    T.StructField("doc_id", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("event", T.StringType()), T.StructField("depth", T.IntegerType()),
    T.StructField("node_type", T.StringType()), T.StructField("name", T.StringType()), T.StructField("attrs", ATTRS), T.StructField("str_value", T.StringType()),
    T.StructField("int_value", T.LongType()), T.StructField("real_value", T.DoubleType()), T.StructField("ws", T.BooleanType()), T.StructField("custom", T.StringType()),
])

#: What a watched scan keeps: events, and the seq of the kept element that each lies directly in.
KEPT = T.StructType([*EVENT.fields[:2], T.StructField("parent_seq", T.LongType()), *EVENT.fields[2:]])

#: How far a watched scan went: one row a document.
SCANNED = T.StructType([
    T.StructField("doc_id", T.StringType()), T.StructField("n_events", T.LongType()), T.StructField("n_nodes", T.LongType()), T.StructField("n_kept", T.LongType()),
    T.StructField("at", T.LongType()), T.StructField("size", T.LongType()), T.StructField("stopped", T.BooleanType()), T.StructField("failed", T.BooleanType()),
])

ERROR = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("line", T.LongType()), T.StructField("message", T.StringType()), T.StructField("fatal", T.BooleanType())])

#: The node table with the part of its document that a node belongs to (operators.whole), and saved documents.
PARTS = T.StructType([*NODE.fields, T.StructField("part", T.IntegerType())])
SAVED = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("xml", T.StringType())])

VALUE_TYPES = ("CUSTOM", "IGNORE", "INTEGER", "OPAQUE", "REAL", "TEXT")


@dataclass(frozen=True)
class LoadOptions:
    """value_type: of all values, unless type_of tells by the element (name, attributes as a dict); None: by default as with
    no options at all, that is IGNORE up to the first tag and TEXT after it. entities: further names, as a mapping or a
    function to a code point (None: unknown). custom_load: text of a CUSTOM value to the string that stands for it (None: refused).
    """

    value_type: str | None = "TEXT"
    type_of: Callable[[str, Mapping[str, str]], str] | None = None
    entities: Mapping[str, int] | Callable[[str], int | None] = field(default_factory=dict)
    custom_load: Callable[[str], str | None] | None = None


class Seen(NamedTuple):
    """What a watching function is told of an event: its kind, node type and name, attributes, value (of its type), the names and attributes
    of the elements it lies in, outermost first, and whether the innermost of these is kept."""

    event: str
    node_type: str | None
    name: str | None
    attrs: Mapping[str, str]
    value: str | int | float | None
    parents: Sequence[tuple[str, Mapping[str, str]]]
    parent_kept: bool


@dataclass(frozen=True)
class Watch:
    """keep: which events are kept; None keeps all. stop: at which event the scan ends; that event still counts, and is kept if keep says so.
    Both run in the scanner, on open elements only, so neither sees more than one document's path."""

    keep: Callable[[Seen], bool] | None = None
    stop: Callable[[Seen], bool] | None = None


class Written(NamedTuple):
    """What a white space function is told of a node: its type, name (elements only), attributes, depth, and whether it has no children."""

    node_type: str
    name: str | None
    attrs: Mapping[str, str]
    depth: int
    leaf: bool


@dataclass(frozen=True)
class SaveOptions:
    """wrap: column after which attributes and values go to a new line, 0 for never. whitespace: (node, place) to the string written
    at the places 'before_open', 'after_open', 'before_close', 'after_close', or None. custom_save: the text of a CUSTOM value.
    """

    wrap: int = 72
    whitespace: Callable[[Written, str], str | None] | None = None
    custom_save: Callable[[str], str | None] | None = None
