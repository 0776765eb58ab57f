"""Many paths at once against one at a time, and scans that keep and stop against the same conditions on whole event tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sylva.functions.schema import LoadOptions, Watch
from sylva.operators import find
from sylva.sources.store import stored
from sylva.sources.xml import events, kept_events, scanned, shred
from sylva.streaming.sax import until_stop, with_parent

PATHS = ["a", "*/a", "r", "r/a", "*/r/a", "r/*/a", "r/a/a", "r/a/b/c", "r/*/b/*/c", "*/b/a", "*/c/*/c", "*/a/*/a/*/a", "r/b", "r/b", "", "/", "r//a", "r/a/", "*/*/a", "d/" + "x" * 256, "r/c/*/d", "*/x&y"]


def tree(rng, n):
    out, open_ = [], []
    for _ in range(n):
        while open_ and rng.random() < 0.45:
            out.append(f"</{open_.pop()}>")
        if rng.random() < 0.3:
            out.append(rng.choice(["word ", "<!--xx-->", "<![CDATA[c]]>"]) if open_ else "")
        name = rng.choice("aabcd")
        out.append(f"<{name} k='{rng.randrange(4)}'>")
        open_.append(name)
    return "<r>" + "".join(out) + "".join(f"</{x}>" for x in reversed(open_)) + "</r>"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(11)
    rows = [(f"t{i}", rng.choice(["<?xml?>", "", ""]) + tree(rng, rng.randrange(40))) for i in range(60)]
    rows += [("large", tree(rng, 3000)), ("flat", "<r>" + "<a/><b>x</b>" * 500 + "</r>"), ("empty", ""), ("null", None), ("bad", "<r><a k='1'>x</b></r>"), ("cut", "<r><a k='3'/><b")]
    return spark.createDataFrame(rows, "doc_id string, xml string").repartition(5)


def found(df):
    return {(r["doc_id"], r["node_id"], r["name"], r["str_value"]) for r in df.collect()}


@pytest.mark.parametrize("batch", [3, 10_000])
def test_paths_at_once_as_one_by_one(spark, docs, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        n = stored(shred(docs))
        together = find.find_paths(n, PATHS).collect()
        by_path = {p: {(r["doc_id"], r["node_id"], r["name"], r["str_value"]) for r in together if r["path"] == p} for p in PATHS}
        assert by_path == {p: found(find.find_path(n, p)) for p in PATHS} and len(together) == sum(map(len, by_path.values())) > 200
        top = n.filter("name = 'b'").groupBy("doc_id").agg(F.min("node_id").alias("top"))
        below = find.find_paths(n, PATHS, top).collect()
        for p in PATHS:
            assert {(r["doc_id"], r["node_id"], r["name"], r["str_value"]) for r in below if r["path"] == p} == found(find.find_path(n, p, top))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_paths_of_nothing(spark, docs):
    n = shred(docs)
    assert find.find_paths(n, []).collect() == [] and find.find_paths(n.limit(0), ["r"]).collect() == []
    plan = find.find_paths(n, PATHS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") + plan.count("Exchange REBALANCE") <= 2  # one to spread the documents, one for all paths


def keep(seen):
    return seen.event == "ELEMENT_OPEN" and seen.name in "ab" or seen.event == "DATA" and seen.parent_kept


def stop(seen):
    return seen.event == "ELEMENT_OPEN" and seen.attrs.get("k") == "3" and any(name == "b" for name, _ in seen.parents)


def test_kept_and_stopped_scans(docs):
    e = stored(with_parent(events(docs)))
    rows = {}
    for r in e.orderBy("doc_id", "seq").collect():
        rows.setdefault(r["doc_id"], []).append(r)
    want, far = set(), {}
    for doc, all_ in rows.items():
        opened = {r["seq"]: r for r in all_ if r["event"] == "ELEMENT_OPEN"}
        held = {s for s, r in opened.items() if r["name"] in "ab"}
        for r in all_:
            up = r["parent_seq"]
            if r["seq"] in held or r["event"] == "DATA" and up in held:
                want.add((doc, r["seq"], up if up in held else None, r["event"], r["name"], r["str_value"]))
            over = up
            inside = False
            while over is not None:
                inside |= opened[over]["name"] == "b"
                over = opened[over]["parent_seq"]
            if inside and r["event"] == "ELEMENT_OPEN" and any(a["name"] == "k" and a["value"] == "3" for a in r["attrs"]):
                far[doc] = r["seq"]
                break
    got = kept_events(docs, Watch(keep, stop)).collect()
    assert {(r["doc_id"], r["seq"], r["parent_seq"], r["event"], r["name"], r["str_value"]) for r in got} == want
    report = {r["doc_id"]: r for r in scanned(docs, Watch(keep, stop)).collect()}
    texts = {r["doc_id"]: r["xml"] for r in docs.collect() if r["xml"] is not None}
    assert set(report) == set(texts) and {d for d, r in report.items() if r["stopped"]} == set(far) and len(far) > 10
    kept = {}
    for doc, *_ in want:
        kept[doc] = kept.get(doc, 0) + 1
    for d, r in report.items():
        assert r["n_events"] == (far[d] + 1 if d in far else len(rows.get(d, []))) and r["n_kept"] == kept.get(d, 0) and r["size"] == len(texts[d])
        assert r["failed"] == (d == "bad" and d not in far)
        if d in far:
            assert r["at"] < r["size"] and "k='3'" in texts[d][r["at"] :]
        elif not r["failed"]:
            assert r["at"] == r["size"]


def test_a_stop_hides_what_comes_after(spark):
    """What is wrong after the stop isn't noticed, as the scan never gets there."""
    d = spark.createDataFrame([("x", "<r><s/></oops>")], "doc_id string, xml string")
    at_s = Watch(stop=lambda seen: seen.name == "s")
    assert [tuple(r) for r in scanned(d, at_s).select("n_events", "n_nodes", "at", "stopped", "failed").collect()] == [(2, 2, 3, True, False)]
    assert scanned(d, Watch()).select("stopped", "failed").first() == (False, True)
    assert [r["seq"] for r in until_stop(events(d), F.col("name") == "s").orderBy("seq").collect()] == [0, 1] == [r["seq"] for r in kept_events(d, at_s).orderBy("seq").collect()]


def test_values_of_each_type_are_seen(spark):
    """Values reach the watching function in their own type."""
    d = spark.createDataFrame([("x", "<r><integer>7</integer><real>0.5</real><opaque>a b</opaque></r>")], "doc_id string, xml string")
    options = LoadOptions(type_of=lambda name, attrs: name.upper() if name != "r" else "IGNORE")
    big = Watch(keep=lambda seen: seen.event == "DATA" and seen.value in (7, 0.5, "a b"))
    assert kept_events(d, big, options=options).count() == 3
