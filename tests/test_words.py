"""The words of elements, joined in runs within tasks: what a walk over each document's nodes gives, with one reading of the table."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sylva.operators import find, values
from sylva.plans import queries
from sylva.sources.store import stored
from sylva.sources.xml import shred


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(17)
    words = lambda: "".join(rng.choice(["one", "two words", " before", "after ", "\n", "", "&amp;"]) for _ in range(rng.randrange(5)))
    body = lambda: words() + "".join(rng.choice([f"<p>{words()}</p>", f"<p/>{words()}", f"<q>{words()}<p>{words()}</p>{words()}</q>", "<!-- x -->"]) for _ in range(rng.randrange(6))) + words()
    rows = [(f"d{i}", f"<p>{body()}</p>") for i in range(60)] + [("long", "<p>" + "word " * 500 + "</p>"), ("empty", "<p></p>")]
    return stored(shred(spark.createDataFrame(rows, "doc_id string, xml string")))


@pytest.mark.parametrize("rows", [10_000, 3])
def test_words(spark, table, rows):
    nodes = {(r["doc_id"], r["node_id"]): r for r in table.collect()}
    of = {at: [] for at, r in nodes.items() if r["name"] == "p"}
    for (d, _), r in sorted(nodes.items()):
        if r["node_type"] == "TEXT" and (d, r["parent_id"]) in of:
            of[d, r["parent_id"]].append(r)
    wanted = {(*at, sum(w["str_value"] != "" for w in ws), "".join(" " * w["ws"] + w["str_value"] for w in ws)) for at, ws in of.items()}
    assert len(wanted) > 150 and any(n > 400 for _, _, n, _ in wanted) and any(not text for *_, text in wanted)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        for n in (table, table.repartition(7, F.rand(1))):
            for asked in (find.matches("p"), table.filter("name = 'p'")):
                assert {tuple(r) for r in values.words_of(n, asked, count="n").select("doc_id", "node_id", "n", "text").collect()} == wanted
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_first_children(spark, table):
    """Of values only first children are joined, and not by a broadcast, whatever size the files have."""
    got = values.value_of(table, table.filter("name = 'p'"), "TEXT")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    nodes = {(r["doc_id"], r["node_id"]): r for r in table.collect()}
    first = {at: nodes.get((at[0], at[1] + 1)) for at, r in nodes.items() if r["name"] == "p"}
    said = {at: c["str_value"] if c and c["node_type"] == "TEXT" and c["parent_id"] == at[1] else None for at, c in first.items()}
    assert {(r["doc_id"], r["node_id"]): r["value"] for r in got.collect()} == said


def test_one_reading(spark):
    """text_words loads its documents once, and joins nothing."""
    plan = queries.queries()["text_words"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Join" not in plan
