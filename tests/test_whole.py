"""Steps on whole documents as they are loaded: the same as the edits of node tables, and nothing but the documents is shuffled."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sylva.functions.schema import LoadOptions, SaveOptions
from sylva.operators import edit, find, whole
from sylva.plans import queries
from sylva.plans.documents import orders
from sylva.sources import save
from sylva.sources.store import stored
from sylva.sources.xml import _nodes_of, saved, shred
from tests.test_batch import LOG, Model, logs, seen, shape
from tests.test_queries import DIR

PIECES = ["two words", "7", "a &amp; b &lt;", "<!-- x -->", "<![CDATA[<&>]]>", "<?p q?>", "line\nbreak ", " ", '<b k="1"/>', "<b k='&quot;2'>x<c/></b>", '<c k="é" j="&apos;">7 8</c>', "<b>y</b>", "<n>5</n>", "<n>1 2</n>", "<r>2.50</r>", "é ü"]


def markup(rng):
    inner = "".join(rng.choice(PIECES) for _ in range(rng.randrange(9)))
    inner = f'<a k="{rng.randrange(3)}">{inner}</a>' * rng.randrange(3) + inner
    return rng.choice(['<?xml version="1.0"?>', "", "<!DOCTYPE a>"]) + f"<a>{inner}" + rng.choice(["</a>"] * 19 + [""])


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(8)
    rows = [(f"d{i}", markup(rng)) for i in range(400)] + [("null", None), ("none", ""), ("plain", "<a/>"), ("root", "<b k='1'/>")]
    return spark.createDataFrame(rows, "doc_id string, xml string").repartition(3)


def types(name, attrs):
    return {"n": "INTEGER", "r": "REAL", "c": "OPAQUE"}.get(name, "TEXT")


TYPES = LoadOptions(type_of=types)


def rows(d):
    return sorted(map(repr, d.drop("user_data").collect()))


@pytest.mark.parametrize("binary", [False, True])
def test_saved(docs, binary):
    given = docs.withColumn("xml", F.encode("xml", "UTF-8")) if binary else docs
    for options in (LoadOptions(), LoadOptions("OPAQUE"), TYPES):
        assert rows(saved(given, options=options)) == rows(save.to_documents(shred(docs, options=options)))
    assert rows(saved(docs, save=SaveOptions(10))) == rows(save.to_documents(shred(docs), SaveOptions(10)))


def test_most_texts_are_made_by_arrays(docs, monkeypatch):
    n = []
    monkeypatch.setattr(save, "_flow", lambda options: n.append(options))
    batch = docs.filter("xml like '<a>%</a>' and xml not like '%line%'").toArrow().combine_chunks().to_batches()[0]
    made = [t for _, nodes in _nodes_of(iter([batch]), TYPES, frozenset({*save.NODE_FIELDS, "parent_id", "attrs"}), ()) for t in save.texts_of(nodes, SaveOptions(wrap=0))]
    assert sum(len(trees) for trees, _ in made) > 50 and not n


@pytest.mark.parametrize("test", [("b",), ("b", "k"), ("b", "k", "1"), (None, "k"), (None, None, "1"), ()])
def test_deletions(docs, test):
    n = stored(shred(docs, options=TYPES))
    assert rows(shred(docs, options=TYPES, steps=[whole.deleted(whole.matching(*test))])) == rows(edit.delete(n, find.find_all(n, *test)))


def test_all_of_a_document_deleted(docs):
    assert shred(docs, steps=[whole.deleted(lambda n: n.node == 0)]).isEmpty() and saved(docs, steps=[whole.deleted(lambda n: n.node == 0)]).isEmpty()


def test_taken_out(docs):
    n = stored(shred(docs, options=TYPES))
    targets = find.find_all(n, "b").groupBy("doc_id").agg(F.min("node_id").alias("node_id"))
    got = stored(shred(docs, options=TYPES, columns=[*n.columns, "part"], steps=[whole.taken_out(whole.matching("b"))]))
    for part, want in enumerate(edit.remove(n, targets)):
        assert rows(got.filter(F.col("part") == part).drop("part")) == rows(want)


def test_beside(docs):
    got = stored(shred(docs, columns=["doc_id", "node_id", "name", "part"], steps=[whole.beside(whole.deleted(whole.matching("b")))]))
    assert rows(got.filter("part = 0").drop("part")) == rows(shred(docs, columns=["doc_id", "node_id", "name"]))
    assert rows(got.filter("part = 1").drop("part")) == rows(shred(docs, columns=["doc_id", "node_id", "name"], steps=[whole.deleted(whole.matching("b"))]))


def test_logs(spark):
    rng, held, texts = random.Random(23), {}, []
    for i in range(200):
        xml, n = shape(rng, 1 + rng.randrange(60))
        texts.append((f"d{i}", xml.replace(" ", f' id="d{i}" ', 1)))
        if i % 5:
            held[f"d{i}"] = logs(rng, f"d{i}", n, rng.randrange(1, 30))

    def log_of(n):
        ids = whole.attr(n, "id").take(pa.array(n.first)).to_pylist()
        e = [(tree, *row) for tree, d in enumerate(ids) for row in held.get(d, ())]
        column = lambda i: np.array([whole.NONE if r[i] is None else r[i] for r in e], np.int64)
        values = {c.split()[0]: pa.array([r[i + 1] for r in e], pa.string()) for i, c in enumerate(LOG.split(", ")) if i > 6}
        return whole.Log(column(0), np.array([whole.OPS.index(r[3]) for r in e], np.int64), column(4), column(5), column(6), np.array([r[7] == "BEFORE" for r in e], bool), **values)

    given = spark.createDataFrame(texts, "doc_id string, xml string").repartition(3)
    models = {}
    for r in shred(given).collect():
        models.setdefault(r["doc_id"], []).append(r)
    models = {d: Model(d, rows) for d, rows in models.items()}
    for d, log in held.items():
        for e in log:
            models[d].edit(e)
    assert seen(shred(given, steps=[whole.edited(log_of)]).collect()) == sorted(r for m in models.values() for r in m.rows())


def test_values_of_logs(spark):
    """SET takes values of the node's own type only, the last one; of several attributes of one node each is done."""
    given = spark.createDataFrame([("x", "<a>one two<b k='1'/></a>"), ("y", "<a/>")], "doc_id string, xml string")

    def log_of(n):
        tree = n.tree[n.node == 3].repeat(6)
        return whole.Log(tree, np.tile([whole.SET, whole.SET, whole.SET, whole.ATTR, whole.ATTR, whole.ATTR], len(tree) // 6), np.tile([1, 1, 3, 3, 3, 9], len(tree) // 6), name=pa.array(["no", None, "c", None, None, None] * (len(tree) // 6), pa.string()),
                         str_value=pa.array(["uno", "eins", "no", None, None, None] * (len(tree) // 6), pa.string()), attr=pa.array([None, None, None, "k", "j", "k"] * (len(tree) // 6), pa.string()), value=pa.array([None, None, None, None, "2", "3"] * (len(tree) // 6), pa.string()))

    assert sorted(map(tuple, saved(given, steps=[whole.edited(log_of)]).collect())) == [("x", '<a>eins two<c j="2"/></a>'), ("y", "<a/>")]


@pytest.mark.parametrize("name", ["save_string", "save_io", "save_roundtrip", "delete_subtree", "edit_log", "remove_subtree", "path_no_backtrack"])
def test_nodes_are_not_shuffled(spark, name):
    """Beside the documents' own parts no more than what a path or a tree taken out leaves goes through one shuffle."""
    exchanges = lambda d: d._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    more = {"path_no_backtrack": 1, "remove_subtree": 1}.get(name, 0)
    assert exchanges(queries.queries()[name](spark, DIR)) <= exchanges(orders(spark, DIR)) + more


def test_index_is_kept_up_without_logs(spark, monkeypatch):
    """Both states of the orders come from one load: no node table is edited, and no log is planned."""
    from sylva.operators import batch

    def no(*a, **b):
        raise AssertionError("a node table is edited")

    monkeypatch.setattr(batch, "edit_plan", no)
    monkeypatch.setattr(edit, "delete", no)
    assert queries.queries()["index_stored"](spark, DIR).count() > 0
