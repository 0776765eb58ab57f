"""The stored index: equal to a fresh one after each kind of change, answers by pushed filters, and what failed writes leave."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from sylva.operators import edit, find, index
from sylva.operators.stored_index import StoredIndex
from sylva.sources.store import stored
from sylva.sources.xml import shred


def table_of(df):
    return sorted((tuple(map(repr, r)) for r in df.select("doc_id", "pos", "node_id", "name", "value").collect()))


def documents(spark, rng, ids):
    item = lambda: f"<{rng.choice(['a', 'b', 'é'])} k='{rng.choice(['', 'x', 'Y', '10', '9', '&lt;'])}'/><c/>"
    return spark.createDataFrame([(i, "<?xml?><r k='top'>" + "".join(item() for _ in range(rng.randrange(6))) + "</r>") for i in ids] or [], "doc_id string, xml string")


@pytest.mark.parametrize("element,attribute", [(None, None), ("a", None), (None, "k"), ("a", "k"), ("no", "k")])
def test_changes_and_merges(spark, tmp_path, element, attribute):
    rng = random.Random(f"{element}{attribute}")
    n = stored(shred(documents(spark, rng, [f"d{i}" for i in range(30)])))
    ind = StoredIndex(spark, str(tmp_path / "i")).build(n, element, attribute)
    first = table_of(index.index(n, element, attribute))
    assert table_of(ind.table()) == first
    # Some documents new, some others gone, some with other nodes, twice; then the same from one folder.
    for step, ids in enumerate((["d1", "d2", "new"], ["d2", "d3", "new", "newer"])):
        made = shred(documents(spark, rng, ids))
        gone = f"d{10 + step}"
        n = stored(n.filter(~F.col("doc_id").isin(*ids, gone)).unionByName(made))
        ind.update(n, spark.createDataFrame([(i,) for i in [*ids, gone, gone, None]], "doc_id string"))
        assert table_of(ind.table()) == table_of(index.index(n, element, attribute))
    for _ in range(2):
        for value in ("x", "", "none", None):
            want = index.index_find(index.index(n, element, attribute), "a", value).select("doc_id", "node_id", "nth").collect()
            assert sorted(map(tuple, ind.find("a", value).select("doc_id", "node_id", "nth").collect())) == sorted(map(tuple, want))
        assert table_of(StoredIndex(spark, ind.path, 0).table()) == first
        ind.merge()
    ind.vacuum()
    assert table_of(ind.table()) == table_of(index.index(n, element, attribute))
    assert len([f for f in os.listdir(ind.path) if f != "versions"]) == 1


def test_answers_are_nodes(spark, tmp_path):
    """What the index gives is what find_all() gives, with places in the tree to go on from."""
    n = stored(shred(documents(spark, random.Random(1), [f"d{i}" for i in range(20)])))
    ind = StoredIndex(spark, str(tmp_path / "i")).build(n, attribute="k")
    columns = ("doc_id", "node_id", "parent_id", "last_desc", "depth", "ord", "name")
    assert sorted(map(tuple, ind.rows("b", "x").select(*columns).collect())) == sorted(map(tuple, find.find_all(n, "b", "k", "x").select(*columns).collect()))


def test_edits_reach_the_index(spark, tmp_path):
    n = stored(shred(documents(spark, random.Random(2), [f"d{i}" for i in range(20)])))
    ind = StoredIndex(spark, str(tmp_path / "i")).build(n, "a", "k")
    hits = find.find_all(n, "a", "k", "x")
    after = stored(edit.delete(n, hits))
    ind.update(after, hits)
    assert ind.rows("a", "x").count() == 0 and table_of(ind.table()) == table_of(index.index(after, "a", "k"))


def test_plan_reads_the_index_only(spark, tmp_path):
    n = stored(shred(documents(spark, random.Random(3), [f"d{i}" for i in range(20)])))
    ind = StoredIndex(spark, str(tmp_path / "i")).build(n, "a", "k")
    answer = ind.rows("a", "x")
    plan = answer._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "EqualTo(name,a)" in plan and "EqualTo(value,x)" in plan and "PartitionFilters: [isnotnull(bucket" in plan and "Exchange" not in plan
    assert plan.count("Location:") == 1 and "/i/entries-" in plan
    files = {f.split("bucket=")[1].split("/")[0] for f in answer.select(F.input_file_name().alias("f")).distinct().toPandas()["f"]} if answer.count() else set()
    assert len(files) <= 1


def test_failed_writes_are_not_seen(spark, tmp_path):
    n = stored(shred(documents(spark, random.Random(4), [f"d{i}" for i in range(20)])))
    ind = StoredIndex(spark, str(tmp_path / "i")).build(n, "a", "k")
    before = table_of(ind.table())
    bad = n.withColumn("last_desc", F.when(F.col("doc_id") == "d3", F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("last_desc")))
    with pytest.raises(Exception, match="broken"):
        ind.update(bad, n.select("doc_id"))
    assert table_of(ind.table()) == before
    left = len(os.listdir(ind.path))
    ind.vacuum()
    assert len(os.listdir(ind.path)) < left and table_of(ind.table()) == before
    with pytest.raises(ValueError):
        StoredIndex(spark, ind.path, 7).rows()


def test_empty_table(spark, tmp_path):
    n = shred(documents(spark, random.Random(5), []))
    ind = StoredIndex(spark, str(tmp_path / "i")).build(n)
    assert ind.rows().collect() == [] and ind.find("a").collect() == []
    ind.update(shred(documents(spark, random.Random(5), ["one"])), spark.createDataFrame([("one",)], "doc_id string")).merge()
    assert ind.rows("r").count() == 1
