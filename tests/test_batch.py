"""Edit logs against a tree of Python objects that does the same edits one after the other."""

from __future__ import annotations

import random

import pytest

from sylva.functions.schema import NODE
from sylva.operators import batch
from sylva.operators.batch import apply_edits, edit_errors
from sylva.sources.xml import shred

COLUMNS = [f.name for f in NODE.fields]
LOG = "doc_id string, seq long, op string, node long, parent long, child long, where string, node_type string, name string, str_value string, attr string, value string"


class Item:
    def __init__(self, name, attrs=(), text=None):
        self.name, self.attrs, self.text, self.up, self.kids = name, dict(attrs), text, None, []


class Model:
    """One document: what a tree of pointers does."""

    def __init__(self, doc, rows):
        self.doc, self.at, self.dead = doc, {}, set()
        for r in sorted(rows, key=lambda r: r["node_id"]):
            x = self.at[r["node_id"]] = Item(r["name"], {a["name"]: a["value"] for a in r["attrs"] or ()}, r["str_value"])
            if r["parent_id"] is not None:
                x.up = self.at[r["parent_id"]]
                x.up.kids.append(x)
        self.root = self.at[0]

    def gone(self, x):
        while x is not None:
            if x in self.dead:
                return True
            x = x.up
        return False

    def add(self, x, parent, child, where):
        p = self.at.get(parent)
        up = p
        if p is None or self.gone(p):
            return False
        while up is not None:
            if up is x:
                return False
            up = up.up
        self.take(x)
        c = self.at.get(child)
        near = p.kids.index(c) if c is not None and c.up is p else None
        spot = (0 if near is None else near) if where == "BEFORE" else (len(p.kids) if near is None else near + 1)
        p.kids.insert(spot, x)
        x.up = p
        return True

    def take(self, x):
        if x.up is not None:
            x.up.kids.remove(x)
            x.up = None

    def edit(self, e):
        _, _, op, node, parent, child, where, kind, name, text, attr, value = e
        x = self.at.get(node)
        if op == "NEW":
            if node >= 0 or x is not None:
                return False
            self.at[node] = Item(name, (), text)
            return parent is None or self.add(self.at[node], parent, child, where)
        if op in ("SET", "ATTR"):
            if x is not None and x.name is not None:
                if op == "SET":
                    x.name = name
                elif value is None:
                    x.attrs.pop(attr, None)
                else:
                    x.attrs[attr] = value
            return True
        if x is None or self.gone(x):
            return False
        if op == "ADD":
            return self.add(x, parent, child, where)
        self.take(x)
        if op == "DELETE":
            self.dead.add(x)
        return True

    def rows(self):
        out = []

        def walk(x, parent, depth, place):
            at = len(out)
            out.append(None)
            for i, k in enumerate(x.kids):
                walk(k, at, depth + 1, i)
            out[at] = (self.doc, at, parent, len(out) - 1, depth, place, x.name, tuple(x.attrs.items()), x.text)

        if not self.root.up and self.root not in self.dead:
            walk(self.root, None, 0, 0)
        return out


def seen(rows):
    return sorted((r["doc_id"], r["node_id"], r["parent_id"], r["last_desc"], r["depth"], r["ord"], r["name"], tuple((a["name"], a["value"]) for a in r["attrs"] or ()), r["str_value"]) for r in rows)


def shape(rng, left, depth=0):
    """A random tree of elements a, b, c .. as text, and how many nodes it has."""
    name, n, inner = rng.choice("abcdef"), 1, []
    while n < left and rng.random() < (0.9 if depth < 2 else 0.55):
        text, more = shape(rng, min(left - n, 1 + rng.randrange(12)), depth + 1)
        inner.append(text)
        n += more
    return f'<{name} k="{rng.randrange(9)}">{"".join(inner)}</{name}>', n


def logs(rng, doc, n, edits):
    """Edits that hang together, some of them senseless."""
    handles, out = list(range(n)), []
    for seq in range(edits):
        op = rng.choices(["NEW", "ADD", "REMOVE", "DELETE", "SET", "ATTR"], [5, 6, 1, 0.6, 1, 1])[0]
        pick = lambda: rng.choice(handles[-6:] if rng.random() < 0.4 else handles)
        if op == "NEW":
            node = -len(handles)
            out.append((doc, seq, op, node, rng.choice([None, pick(), pick()]), rng.choice([None, pick()]), rng.choice(["BEFORE", "AFTER"]), "ELEMENT", f"n{-node}", None, None, None))
            handles.append(node)
        elif op == "ADD":
            out.append((doc, seq, op, pick() if rng.random() < 0.95 else 10**6, pick(), rng.choice([None, pick(), pick()]), rng.choice(["BEFORE", "AFTER"]), None, None, None, None, None))
        elif op == "SET":
            out.append((doc, seq, op, pick(), None, None, None, None, f"s{seq}", None, None, None))
        elif op == "ATTR":
            out.append((doc, seq, op, pick(), None, None, None, None, None, None, rng.choice("kxy"), rng.choice([None, f"v{seq}"])))
        elif rng.random() < 0.8 or len(out) > 3:
            out.append((doc, seq, op, max(1, pick()) if rng.random() < 0.9 else pick(), None, None, None, None, None, None, None, None))
    return out


@pytest.mark.parametrize("large", [False, True])
def test_logs(spark, monkeypatch, large):
    if large:  # all documents by ranges of ranks
        monkeypatch.setattr(batch, "LARGE_NODES", 16)
        monkeypatch.setattr(batch, "CELL", 8)
    rng, docs, log = random.Random(19 + large), [], []
    for i in range(150):
        xml, n = shape(rng, 1 + rng.randrange(60))
        docs.append((f"d{i}", xml))
        if i % 5:
            log += logs(rng, f"d{i}", n, rng.randrange(1, 30))
    log.append(("nowhere", 0, "DELETE", 1, *[None] * 8))
    n = batch.stored(shred(spark.createDataFrame(docs, "doc_id string, xml string")))
    given = spark.createDataFrame(rng.sample(log, len(log)), LOG)
    models = {}
    for r in n.collect():
        models.setdefault(r["doc_id"], []).append(r)
    models = {d: Model(d, rows) for d, rows in models.items()}
    wrong = {(e[0], e[1]) for e in log if e[0] in models and not models[e[0]].edit(e)}
    got = apply_edits(n, given)
    assert got.columns == COLUMNS
    assert seen(got.collect()) == sorted(r for m in models.values() for r in m.rows())
    assert {(r["doc_id"], r["seq"]) for r in edit_errors(n, given).collect()} == wrong and len(wrong) > 20


def test_long_chain(spark):
    """Thousands of nodes, each put after or below the one before it."""
    n = batch.stored(shred(spark.createDataFrame([("a", "<a><b/><c/></a>"), ("b", "<a/>")], "doc_id string, xml string")))
    count = 3000
    row = lambda doc, i, parent, child, where: (doc, i, "NEW", -i, parent, child, where, "ELEMENT", f"n{i}", None, None, None)
    log = [row("a", i, 0, 1 if i == 1 else 1 - i, "AFTER") for i in range(1, count)] + [row("b", i, 0 if i == 1 else 1 - i, None, "AFTER") for i in range(1, count)]
    got = apply_edits(n, spark.createDataFrame(log, LOG), values=False)
    rows = sorted((r["doc_id"], r["node_id"], r["parent_id"], r["last_desc"], r["depth"], r["ord"], r["name"]) for r in got.collect())
    flat = [("a", 0, None, count + 1, 0, 0, "a"), ("a", 1, 0, 1, 1, 0, "b"), *(("a", i + 1, 0, i + 1, 1, i, f"n{i}") for i in range(1, count)), ("a", count + 1, 0, count + 1, 1, count, "c")]
    deep = [("b", i, i - 1 if i else None, count - 1, i, 0, f"n{i}" if i else "a") for i in range(count)]
    assert rows == flat + deep


def test_values(spark):
    n = batch.stored(shred(spark.createDataFrame([("d", "<a>one two<b>x</b></a>")], "doc_id string, xml string")))
    schema = LOG + ", int_value long"
    log = [("d", 0, "SET", 1, *[None] * 5, "uno", None, None, 7), ("d", 1, "SET", 2, *[None] * 8, 5), ("d", 2, "NEW", -1, 3, None, None, "INTEGER", None, None, None, None, 42), ("d", 3, "SET", -1, *[None] * 8, 43)]
    got = {r["node_id"]: (r["node_type"], r["str_value"], r["int_value"]) for r in apply_edits(n, spark.createDataFrame(log, schema)).collect()}
    assert got == {0: ("ELEMENT", None, None), 1: ("TEXT", "uno", None), 2: ("TEXT", "two", None), 3: ("ELEMENT", None, None), 4: ("TEXT", "x", None), 5: ("INTEGER", None, 43)}


def test_nothing_to_do(spark):
    n = batch.stored(shred(spark.createDataFrame([("d", "<a><b/></a>")], "doc_id string, xml string")))
    empty = spark.createDataFrame([], LOG)
    assert seen(apply_edits(n, empty).collect()) == seen(n.collect()) and apply_edits(n.limit(0), empty).count() == 0


def test_values_of_documents_without_other_edits(spark):
    """SET and ATTR rows hold also where nothing is added, moved or deleted."""
    n = shred(spark.createDataFrame([("x", "<a><b/></a>"), ("y", "<a><b/></a>")], "doc_id string, xml string"))
    log = spark.createDataFrame([("x", 0, "SET", 1, None, None, None, None, "c", None, None, None), ("y", 0, "DELETE", 1, None, None, None, None, None, None, None, None)], LOG)
    assert sorted((r["doc_id"], r["name"]) for r in apply_edits(n, log).collect()) == [("x", "a"), ("x", "c"), ("y", "a")]


def test_many_logs_are_never_broadcast(spark, monkeypatch):
    """A table that is small as files and large as rows is joined by sorting."""
    from sylva.operators import edit
    from sylva.sources import store

    monkeypatch.setattr(store, "LITTLE", 10)
    monkeypatch.setattr(batch, "LITTLE", 10)
    docs = spark.range(40).selectExpr("cast(id as string) as doc_id", "'<a><b/><b/></a>' as xml")
    n = store.stored(shred(docs))
    left = edit.delete(n, n.filter("name = 'b' and ord = 0"))
    assert left.count() == 80
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
