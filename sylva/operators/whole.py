"""Steps on documents that a task holds whole as it loads them: deletions, subtrees taken out and edit logs by array operations, without any shuffle.

A step is a function of Nodes, the nodes of some documents, that gives Nodes; shred() and saved() (sources.xml) do steps before they give out anything. They
are for what follows from a document itself; for targets and logs that come from other tables, and for documents too large for a task, there are edit.py and batch.py.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.pandas.types import to_arrow_schema

from sylva.functions.schema import NODE
from sylva.operators.batch import _Document

_KINDS = {f.name: f.type for f in to_arrow_schema(NODE) if f.name != "doc_id"}
#: What places a node, which steps need, and what they pick nodes by.
PLACES = ("node_id", "parent_id", "last_desc", "depth", "ord")
PICKED = ("node_type", "name", "attrs")
_VALUE = {"name": ("ELEMENT",), "str_value": ("CDATA", "COMMENT", "DECLARATION", "DIRECTIVE", "OPAQUE", "TEXT"), "int_value": ("INTEGER",), "real_value": ("REAL",), "custom": ("CUSTOM",), "ws": ("TEXT",)}


class Nodes:
    """Whole documents one after the other, each in pre-order: of each node the document's number (doc), the part of it (0; more where a step gives several
    trees of a document), and columns of the node table. Trees are numbered; first, tree and base tell where they begin, a node's tree and its root's row."""

    def __init__(self, doc: np.ndarray, columns: Mapping[str, pa.Array], part: np.ndarray | None = None):
        self.doc, self.columns = doc, dict(columns)
        self.part = np.zeros(len(doc), np.int32) if part is None else part
        self.node = self.columns["node_id"].to_numpy()
        self.first = np.flatnonzero(self.node == 0)
        self.tree = np.cumsum(self.node == 0) - 1
        self.base = self.first[self.tree] if len(doc) else self.tree
        self.size = np.diff(np.append(self.first, len(doc)))
        self.last = self.columns["last_desc"].to_numpy()
        self.end = self.base + self.last
        parent = self.columns["parent_id"].fill_null(-1).to_numpy()
        self.up = np.where(parent >= 0, self.base + parent, -1)

    def __len__(self) -> int:
        return len(self.doc)

    def column(self, name: str) -> np.ndarray:
        """A column of numbers that are never null."""
        return self.columns[name].to_numpy()

    def taken(self, rows: np.ndarray, **placed: pa.Array) -> Nodes:
        """These rows, with other places."""
        at = pa.array(rows)
        return Nodes(self.doc[rows], {c: placed[c] if c in placed else x.take(at) for c, x in self.columns.items()}, self.part[rows])

    def closed_up(self, keep: np.ndarray) -> Nodes:
        """The nodes to keep, without the subtrees of all others, with the places that they have then."""
        if keep.all():
            return self
        count, rows = np.cumsum(keep), np.flatnonzero(keep)
        base, up, place = count[self.base[rows]] - 1, self.up[rows], self.column("ord")[rows].astype(np.int32)
        lost = np.zeros(len(self) + 1, bool)
        lost[self.up[~keep]] = True
        lost[-1] = False
        moved = np.flatnonzero(lost[up])
        moved = moved[np.lexsort((place[moved], up[moved]))]
        if len(moved):
            begins = np.append(True, up[moved][1:] != up[moved][:-1])
            place[moved] = np.arange(len(moved)) - np.flatnonzero(begins)[np.cumsum(begins) - 1]
        return self.taken(rows, node_id=pa.array(count[rows] - 1 - base), last_desc=pa.array(count[self.end[rows]] - 1 - base), parent_id=pa.array(count[up] - 1 - base, mask=up < 0), ord=pa.array(place))


Step = Callable[[Nodes], Nodes]
Pick = Callable[[Nodes], np.ndarray]


def joined(*parts: Nodes) -> Nodes:
    columns = {c: pa.concat_arrays([p.columns[c] for p in parts]) for c in parts[0].columns}
    return Nodes(np.concatenate([p.doc for p in parts]), columns, np.concatenate([p.part for p in parts]))


def attr(n: Nodes, name: str) -> pa.Array:
    """The value of each node's first attribute of that name."""
    lists = n.columns["attrs"]
    flat = lists.flatten()
    hit = np.flatnonzero(pc.fill_null(pc.equal(flat.field("name"), name), False).to_numpy(zero_copy_only=False))
    of, at = np.unique(pc.list_parent_indices(lists).to_numpy()[hit], return_index=True)
    where = np.zeros(len(n), np.int64)
    where[of] = hit[at]
    missing = np.ones(len(n), bool)
    missing[of] = False
    return flat.field("value").take(pa.array(where, mask=missing))


def matching(element: str | None = None, attribute: str | None = None, value: str | None = None) -> Pick:
    """Picks what find.find_all() finds."""

    def pick(n: Nodes) -> np.ndarray:
        if value is not None and attribute is None:
            return np.zeros(len(n), bool)
        said = lambda x: pc.fill_null(x, False).to_numpy(zero_copy_only=False)
        hit = said(pc.equal(n.columns["node_type"], "ELEMENT")) & (n.up >= 0)
        if element is not None:
            hit &= said(pc.equal(n.columns["name"], element))
        if attribute is not None:
            got = attr(n, attribute)
            hit &= said(got.is_valid() if value is None else pc.equal(got, value))
        return hit

    return pick


def first_of_each(n: Nodes, picked: np.ndarray) -> np.ndarray:
    """Of the picked nodes the first of each tree."""
    rows = np.flatnonzero(picked)
    out = np.zeros(len(n), bool)
    out[rows[np.unique(n.tree[rows], return_index=True)[1]]] = True
    return out


def _inside(n: Nodes, tops: np.ndarray) -> np.ndarray:
    rows = np.flatnonzero(tops)
    edge = np.zeros(len(n) + 1, np.int64)
    edge[rows] = 1
    np.subtract.at(edge, n.end[rows] + 1, 1)
    return np.cumsum(edge[:-1]) > 0


def deleted(pick: Pick) -> Step:
    """Without the subtrees of the picked nodes, as edit.delete()."""
    return lambda n: n.closed_up(~_inside(n, pick(n)))


def taken_out(pick: Pick) -> Step:
    """The first picked node's subtree of each document as a tree of its own, part 1, beside the rest of it, part 0: as edit.remove() of a node a document.
    What of a document has no picked node is part 0."""

    def step(n: Nodes) -> Nodes:
        top = first_of_each(n, pick(n))
        inside = _inside(n, top)
        rows = np.flatnonzero(inside)
        at = np.flatnonzero(top)
        root = at[np.searchsorted(at, rows, "right") - 1] if len(at) else rows
        own = root == rows
        cut = n.taken(
            rows, node_id=pa.array(rows - root), last_desc=pa.array(n.end[rows] - root), parent_id=pa.array(n.up[rows] - root, mask=own),
            depth=pa.array((n.column("depth")[rows] - n.column("depth")[root]).astype(np.int32)), ord=pa.array(np.where(own, 0, n.column("ord")[rows]).astype(np.int32)),
        )
        cut.part[:] = 1
        return joined(n.closed_up(~inside), cut)

    return step


def beside(*steps: Step) -> Step:
    """The documents as they are, part 0, and, as part 1, what steps make of them."""

    def both(n: Nodes) -> Nodes:
        after = n
        for step in steps:
            after = step(after)
        return joined(n, Nodes(after.doc, after.columns, np.ones(len(after), np.int32)))

    return both


#: No node, in a log's columns of nodes.
NONE = -(1 << 62)
OPS = ("NEW", "ADD", "REMOVE", "DELETE", "SET", "ATTR")
NEW, ADD, REMOVE, DELETE, SET, ATTR = range(6)


class Log:
    """Edits (as the rows of batch.apply_edits()) of trees by their numbers, ascending, in the order in which they are done. op: an array of places in OPS; node, parent, child: arrays of
    handles, NONE for none; first: whether BEFORE; values: of NEW and SET rows columns of the node table, and attr and value of ATTR rows, as Arrow arrays."""

    def __init__(self, tree: np.ndarray, op: np.ndarray, node: np.ndarray, parent: np.ndarray | None = None, child: np.ndarray | None = None, first: np.ndarray | None = None, **values: pa.Array):
        none = np.full(len(tree), NONE)
        self.tree, self.op, self.node = tree, op, node.astype(np.int64)
        self.parent, self.child = (none if x is None else x.astype(np.int64) for x in (parent, child))
        self.first, self.values = np.zeros(len(tree), bool) if first is None else first, values


#: So many shapes are remembered by a task.
SHAPES = 4096


def _plan(last: np.ndarray, log: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of a tree of this shape (each node's last descendant) after a log (entry, op, node, parent, child, first): handle and entry (-1: an old node),
    node_id, last_desc, parent_id (-1), ord and depth of each node there, in their order."""
    size, lasts = len(last), last.tolist()
    up, depth, place, kids, open_ = [-1] * size, [0] * size, [0] * size, [0] * size, []
    for i, end in enumerate(lasts):
        while open_ and lasts[open_[-1]] < i:
            open_.pop()
        if open_:
            up[i], depth[i], place[i] = open_[-1], len(open_), kids[open_[-1]]
            kids[open_[-1]] += 1
        open_.append(i)
    told = {x for row in log.tolist() for x in row[2:5] if 0 <= x < size}
    named = {x: (lasts[x], up[x] if up[x] >= 0 else None, place[x], depth[x]) for x in told}
    doc = _Document(size, named, {x: kids[x] for x in {*told, *(up[x] for x in told if up[x] >= 0)} if kids[x]})
    entries = {}
    for entry, op, node, parent, child, first in log.tolist():
        handle = lambda x: None if x == NONE else x
        doc.apply(OPS[op], handle(node), handle(parent), handle(child), bool(first), 1, 0, 1)
        if op == NEW:
            entries.setdefault(node, entry)
    made = doc.result()
    stretch: list = [None] * size
    for s in made["stretches"]:
        stretch[s[0] : s[1] + 1] = [s] * (s[1] - s[0] + 1)
    moved, ends, places = {node: rest for node, *rest in made["moved"]}, {}, {}
    for part, rank, *rest in made["ends"]:
        ends.setdefault((part, rank), []).append(rest)
    for parent, *rest in made["places"]:
        places.setdefault(parent, []).append(rest)
    rows = []
    for i in range(size):
        if stretch[i] is None:
            continue
        _, _, shift, deeper, part = stretch[i]
        end = next((e[2] for e in ends.get((part, lasts[i]), ()) if e[0] < depth[i] <= e[1]), None)
        parent, at = moved[i] if i in moved else (up[i] + stretch[up[i]][2] if up[i] >= 0 else -1, place[i] + next((p[2] for p in places.get(up[i], ()) if p[0] <= place[i] <= p[1]), 0))
        rows.append((i + shift, i, -1, lasts[i] + stretch[lasts[i]][2] if end is None else end, -1 if parent is None else parent, at, depth[i] + deeper))
    for node, rank, end, _, deep, parent, at, _ in made["made"]:
        rows.append((rank, node, entries[node], end, -1 if parent is None else parent, at, deep))
    rank, handle, entry, end, parent, at, deep = np.array(sorted(rows), np.int64).reshape(-1, 7).T
    return handle, entry, rank, end, parent, at, deep


def edited(log_of: Callable[[Nodes], Log]) -> Step:
    """Each document after its log, as batch.apply_edits() without units. Documents of one shape and with the same edits of structure are planned once."""
    plans: dict[tuple[bytes, bytes], tuple[np.ndarray, ...]] = {}

    def step(n: Nodes) -> Nodes:
        log = log_of(n)
        structural = log.op < SET
        of, entry = log.tree[structural], np.flatnonzero(structural)
        ends = np.searchsorted(of, np.arange(len(n.first) + 1))
        rows = np.stack([entry - np.searchsorted(log.tree, of), *(x[structural] for x in (log.op, log.node, log.parent, log.child, log.first))], axis=1).astype(np.int64)
        shape, keys = np.full(len(n.first), -1), {}
        for tree in np.flatnonzero(ends[1:] > ends[:-1]).tolist():
            at = n.first[tree]
            key = n.last[at : at + n.size[tree]].tobytes(), rows[ends[tree] : ends[tree + 1]].tobytes()
            shape[tree] = keys.setdefault(key, len(keys))
        sizes, held = n.size.copy(), []
        for last, told in keys:
            if (last, told) not in plans:
                if len(plans) >= SHAPES:
                    plans.clear()
                plans[last, told] = _plan(np.frombuffer(last, np.int64), np.frombuffer(told, np.int64).reshape(-1, 6))
            held.append(plans[last, told])
        of_shape = [np.flatnonzero(shape == i) for i in range(len(held))]
        for trees, plan in zip(of_shape, held):
            sizes[trees] = len(plan[0])
        begin = np.concatenate([[0], np.cumsum(sizes)])
        total, first_entry = int(begin[-1]), np.searchsorted(log.tree, np.arange(len(n.first)))
        source, handle, tree = np.empty(total, np.int64), np.empty(total, np.int64), np.repeat(np.arange(len(n.first)), sizes)
        placed = {c: np.empty(total, np.int64) for c in ("node_id", "last_desc", "parent_id", "ord", "depth")}
        same = shape[n.tree] < 0
        to = begin[n.tree[same]] + n.node[same]
        source[to], handle[to] = np.flatnonzero(same), n.node[same]
        for c, x in zip(placed.values(), (n.node, n.last, np.where(n.up >= 0, n.up - n.base, -1), n.column("ord"), n.column("depth"))):
            c[to] = x[same]
        for trees, (node, made, *places) in zip(of_shape, held):
            to = begin[trees][:, None] + np.arange(len(node))
            source[to] = np.where(made < 0, n.first[trees][:, None] + node, len(n) + first_entry[trees][:, None] + made)
            handle[to] = node
            for c, x in zip(placed.values(), places):
                c[to] = x
        at = pa.array(source)
        columns: dict[str, pa.Array] = {"node_id": pa.array(placed["node_id"]), "last_desc": pa.array(placed["last_desc"]), "parent_id": pa.array(placed["parent_id"], mask=placed["parent_id"] < 0)}
        columns |= {c: pa.array(placed[c].astype(np.int32)) for c in ("ord", "depth")}
        kinds = log.values.get("node_type", pa.nulls(len(log.tree), pa.string()))
        for c, held_ in n.columns.items():
            if c in columns:
                continue
            new = log.values[c].cast(_KINDS[c]) if c in log.values else pa.nulls(len(log.tree), _KINDS[c])
            if c == "attrs":
                new = pc.if_else(pc.fill_null(pc.and_(pc.equal(kinds, "ELEMENT"), new.is_null()), False), pa.scalar([], _KINDS[c]), new)
            if c == "ws":
                new = pc.if_else(pc.fill_null(pc.and_(pc.equal(kinds, "TEXT"), new.is_null()), False), False, new)
            columns[c] = pa.concat_arrays([held_.cast(_KINDS[c]) if held_.type != _KINDS[c] else held_, new]).take(at)
        _with_values(columns, log, tree, handle)
        return Nodes(n.doc[n.first][tree], columns, n.part[n.first][tree])

    return step


def _with_values(columns: dict[str, pa.Array], log: Log, tree: np.ndarray, handle: np.ndarray) -> None:
    """The log's SET and ATTR rows done, in their order."""
    rest = np.flatnonzero(log.op >= SET)
    if not len(rest):
        return
    # The rows of the trees and handles that the log names: both are put in order, so that each is looked up once.
    order = np.lexsort((handle, tree))
    low = int(min(handle.min(initial=0), log.node[rest].min()))
    width = int(max(handle.max(initial=0), log.node[rest].max())) - low + 1
    code = (tree * width + handle - low)[order]
    asked = log.tree[rest] * width + log.node[rest] - low
    found = np.minimum(np.searchsorted(code, asked), max(len(code) - 1, 0))
    hit = code[found] == asked if len(code) else np.zeros(len(asked), bool)
    rest, rows = rest[hit], order[found[hit]]
    kinds = columns["node_type"].take(pa.array(rows)).to_pylist()
    said = {c: x.take(pa.array(rest)).to_pylist() for c, x in log.values.items()}
    ops, changed = log.op[rest].tolist(), {}
    before = dict(zip(rows.tolist(), columns["attrs"].take(pa.array(rows)).to_pylist())) if "attrs" in columns and ATTR in ops else {}
    for i, (row, op, kind) in enumerate(zip(rows.tolist(), ops, kinds)):
        if op == SET:
            for c, given in said.items():
                if c in columns and given[i] is not None and (kind in _VALUE.get(c, ()) or c == "user_data"):
                    changed.setdefault(c, {})[row] = given[i]
        elif kind == "ELEMENT" and "attrs" in columns:
            held, name, value = before[row] or [], said["attr"][i], said["value"][i]
            if value is None:
                held = [a for a in held if a["name"] != name]
            elif any(a["name"] == name for a in held):
                held = [{"name": name, "value": value} if a["name"] == name else a for a in held]
            else:
                held = [*held, {"name": name, "value": value}]
            before[row] = changed.setdefault("attrs", {})[row] = held
    for c, put in changed.items():
        where = np.arange(len(tree))
        where[list(put)] = len(tree) + np.arange(len(put))
        columns[c] = pa.concat_arrays([columns[c], pa.array(list(put.values()), columns[c].type)]).take(pa.array(where))
