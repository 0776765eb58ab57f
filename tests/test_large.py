"""Searches, ancestors and parents of events in one large document beside small ones, in runs of few ranks: the same as in one run."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sylva.operators import batch, edit, find, nav, running
from sylva.sources.store import stored
from sylva.sources.xml import events, shred
from sylva.streaming.sax import with_parent


def tree(rng, n):
    out, open_ = [], []
    for i in range(n):
        while open_ and rng.random() < 0.45:
            out.append(f"</{open_.pop()}>")
        name = rng.choice("abcd")
        out.append(f"<{name} k='{rng.randrange(5)}'>")
        open_.append(name)
    return "<r>" + "".join(out) + "".join(f"</{x}>" for x in reversed(open_)) + "</r>"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    rows = [("large", tree(rng, 900)), ("flat", "<r>" + "<a/><b k='1'/>" * 300 + "</r>"), *((f"s{i}", tree(rng, rng.randrange(9))) for i in range(20))]
    return spark.createDataFrame(rows, "doc_id string, xml string")


@pytest.mark.parametrize("cell", [4, 64])
def test_runs(docs, monkeypatch, cell):
    n, e = stored(shred(docs)), stored(events(docs))
    every = n.select("doc_id", F.col("node_id").alias("cur"), F.lit(0).cast("long").alias("top"))
    inner = every.withColumn("top", F.col("cur"))

    def all_of_it():
        got = {(what, d, at): sorted((r["doc_id"], r["cur"], r["found"] and r["found"]["node_id"]) for r in find.find(n, start, "b", *more, descend=d).collect()) for what, start in (("root", every), ("self", inner)) for more in ((), ("k", "1")) for d in ("ALL", "FIRST", "NONE") for at in (len(more),)}
        got["up"] = sorted(map(tuple, nav.ancestors(n).collect()))
        got["events"] = sorted((r["doc_id"], r["seq"], r["parent_seq"] if r["parent_seq"] is not None else -1) for r in with_parent(e).collect())
        return got

    whole = all_of_it()
    monkeypatch.setattr(running, "CELL", cell)
    assert all_of_it() == whole
    parents = {(r["doc_id"], r["node_id"]): r["parent_id"] for r in n.collect()}
    up = set()
    for (d, node), p in parents.items():
        while p is not None:
            up.add((d, node, p))
            p = parents[d, p]
    assert set(whole["up"]) == up


def test_no_task_has_all_nodes(docs, monkeypatch, spark):
    """What a window sorts at once is no more than a run's ranks."""
    monkeypatch.setattr(running, "CELL", 64)
    n = stored(shred(docs))
    runs = n.groupBy("doc_id", running.cell("node_id")).count().agg(F.max("count")).first()[0]
    assert runs <= 64 < n.filter("doc_id = 'large'").count()
    plan = running.nearest(n, F.col("name"), "x")._jdf.queryExecution().optimizedPlan().toString()
    assert all("_cell" in line or "_carried" in line for line in plan.split("\n") if "Window " in line)


def test_searches_look_at_matches_and_starts_only(spark, monkeypatch):
    """Of a document of 500 nodes the running value sees the 5 matches and the one start."""
    from pyspark.sql import functions as F

    from sylva.operators import find
    from sylva.sources.xml import shred

    seen, whole = [], find.nearest
    monkeypatch.setattr(find, "nearest", lambda df, *a, **b: (seen.append(df.count()), whole(df, *a, **b))[1])
    inner = "".join("<hit/>" if i % 100 == 50 else "<x/>" for i in range(500))
    n = shred(spark.createDataFrame([("d", f"<a>{inner}</a>")], "doc_id string, xml string"))
    start = n.filter("node_id = 52").select("doc_id", F.col("node_id").alias("cur"), F.lit(0).cast("long").alias("top"))
    for how in ("ALL", "NONE"):
        assert find.find(n, start, "hit", descend=how).first()["found"]["node_id"] == 151
    assert seen == [6, 6]


def test_deletions_of_large_documents(spark, docs, monkeypatch):
    """Runs of 16 ranks give what one log gives; the log's own function never sees a large document."""
    n = stored(shred(docs))
    one_in = lambda k: n.filter(F.pmod(F.xxhash64("doc_id", "node_id"), F.lit(k)) == 0).select("doc_id", "node_id")
    many = [one_in(9), one_in(3).unionByName(one_in(5)), n.filter("doc_id = 'flat' and node_id > 1 or node_id = 100000").select("doc_id", "node_id"), n.filter("node_id = 0").select("doc_id", "node_id"), n.filter("node_id = 1 and doc_id = 'large'").select("doc_id", "node_id")]
    rows = lambda d: sorted(map(repr, d.drop("user_data").collect()))
    want = [rows(edit.delete(n, t)) for t in many]
    monkeypatch.setattr(batch, "LARGE_NODES", 16)
    logged, plan = [], batch.edit_plan
    monkeypatch.setattr(batch, "edit_plan", lambda of, log, made=None: logged.append(of.agg(F.max("node_id")).first()[0]) or plan(of, log, made))
    assert [rows(edit.delete(n, t)) for t in many] == want
    assert max(logged) < 16


@pytest.mark.parametrize("how", ["ALL", "FIRST", "NONE"])
def test_searches_told_where_subtrees_end(docs, how):
    """The same answers, without a look at any node but matches and places; one that begins at a match doesn't find it."""
    n = stored(shred(docs))
    asked = n.select("doc_id", F.col("node_id").alias("cur"), F.col("last_desc").alias("cur_last"))
    asked = stored(asked.join(n.filter("parent_id is null").select("doc_id", F.col("last_desc").alias("top_last")), "doc_id")).withColumn("top", F.lit(0).cast("long"))
    rows = lambda d: sorted(map(repr, d.select("doc_id", "cur", F.col("found.node_id").alias("found")).collect()))
    short = find.find(n, asked, "b", descend=how, columns=["node_id"])
    whole = find.find(n, asked.select("doc_id", "cur", "top"), "b", descend=how)
    joins = lambda d: d._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert rows(short) == rows(whole) and joins(short) < joins(whole) and (how != "ALL" or joins(short) == 1)


@pytest.mark.parametrize("large", [1 << 16, 16])
def test_deletions_move_what_is_given(docs, monkeypatch, large):
    """A table with some nodes and columns gives what the whole one does of these; targets given twice and with their places count once."""
    n = stored(shred(docs))
    monkeypatch.setattr(batch, "LARGE_NODES", large)
    hit = find.find_all(n, "b", "k", "1")
    columns = ["doc_id", "node_id", "parent_id", "last_desc", "depth", "ord", "name"]
    some = n.filter("parent_id is null or name = 'b'").select(columns)
    rows = lambda d: sorted(map(repr, d.select(columns).collect()))
    want = rows(edit.delete(n, hit.select("doc_id", "node_id")).filter("parent_id is null or name = 'b'"))
    assert rows(edit.delete(some, hit.unionByName(hit) if large == 16 else hit)) == want
