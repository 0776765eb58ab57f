"""Files read in ranges against loads of the whole file."""

from __future__ import annotations

import random

import pytest

from sylva.functions.schema import LoadOptions
from sylva.plans.callbacks import named_types
from sylva.sources.split import read_records
from sylva.sources.xml import shred

HEAD = "<?xml version='1.0'?>\n<!-- é --><log kind='x'><sub><from>a b</from>text "
TAIL = " more<!-- end --></sub >\n<last>z </last>\n</log><!-- over -->\n"


def records(seed: int, n: int) -> str:
    rng, out = random.Random(seed), []
    for i in range(n):
        inner = "".join(rng.choice(["<p>words é here</p>", "<q k='1'/>", " loose text ", "<integer>7 8</integer>", "<p><p>deep</p></p>", ""]) for _ in range(rng.randrange(6)))
        out.append(rng.choice(["", "\n", " between ", "<other>x</other>", "<!-- note -->"]) + f"<rec id='{i}'>{inner}</rec>")
    return "".join(out)


def whole(spark, text, options):
    return sorted(map(repr, shred(spark.createDataFrame([("d", text)], "doc_id string, xml string"), options=options).collect()))


@pytest.mark.parametrize("n,size", [(1, 10), (7, 64), (400, 700), (400, 10**6)])
@pytest.mark.parametrize("options", [LoadOptions(), LoadOptions(type_of=named_types)])
def test_as_whole(spark, tmp_path, n, size, options):
    text = HEAD + records(n, n) + TAIL
    (tmp_path / "f.xml").write_text(text, encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        nodes, errors = read_records(spark, str(tmp_path / "f.xml"), "rec", "d", options)
        assert spark.read.text(str(tmp_path / "f.xml"), lineSep="</rec>").rdd.getNumPartitions() > 3 or n < 400 or size > 10**5
        got = sorted(map(repr, nodes.collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == whole(spark, text, options) and errors.count() == 0


@pytest.mark.parametrize("text", [HEAD + records(3, 9) + "<rec><p></rec>" + records(4, 9) + TAIL, HEAD + records(3, 9) + " more</sub>", HEAD + records(3, 9), HEAD + records(3, 2) + "<rec>x", HEAD + records(5, 3) + "</log></sub>"])
def test_broken(spark, tmp_path, text):
    """A file that can't be loaded whole can't be loaded in ranges, either."""
    (tmp_path / "f.xml").write_text(text, encoding="utf-8")
    nodes, errors = read_records(spark, str(tmp_path / "f.xml"), "rec", "d", LoadOptions())
    assert sorted(map(repr, nodes.collect())) == whole(spark, text, LoadOptions())
    assert (errors.count() > 0) == (nodes.count() == 0) and {r["doc_id"] for r in errors.collect()} <= {"d"}


@pytest.mark.parametrize("text", ["", "<a><b/></a>", "<rec>x</rec>", "<a></b><rec></rec></a>"])
def test_no_records(spark, tmp_path, text):
    (tmp_path / "f.xml").write_text(text)
    with pytest.raises(ValueError):
        read_records(spark, str(tmp_path / "f.xml"), "rec")


def test_one_file_from_sorted_parts(spark, tmp_path):
    """The parts follow each other by their names, and the result is one file."""
    from sylva.plans.callbacks import joined_files

    (tmp_path / "parts").mkdir()
    for i in (2, 0, 1):
        (tmp_path / "parts" / f"part-0000{i}.txt").write_text(f"line {i}\n")
    spark.range(1).coalesce(1).mapInArrow(joined_files(str(tmp_path / "parts"), str(tmp_path / "whole" / "part-00000.txt")), "id long").count()
    assert (tmp_path / "whole" / "part-00000.txt").read_text() == "line 0\nline 1\nline 2\n"


def test_nodes_of_a_split_file_are_not_joined_by_their_document(spark, tmp_path):
    """Such a join brings all nodes into one task."""
    from sylva.sources.split import read_records

    (tmp_path / "f.txt").write_text("<r>" + "".join(f"<x>{i}</x>" for i in range(9)) + "</r>")
    n, _ = read_records(spark, str(tmp_path / "f.txt"), "x")
    assert n.count() == 19 and "LeftAnti" not in n._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("options", [LoadOptions(), LoadOptions("IGNORE"), LoadOptions(type_of=lambda name, attrs: "IGNORE" if name == "sub" else named_types(name, attrs))])
def test_columns_and_elements(spark, tmp_path, options):
    """Of some columns and elements the same as of all, with plain records by arrays, too; nodes are neither shuffled nor stored twice."""
    (tmp_path / "f.xml").write_text(HEAD + records(6, 300) + TAIL, encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        columns = ["doc_id", "node_id", "parent_id", "last_desc", "ord", "name"]
        every, some = (read_records(spark, str(tmp_path / "f.xml"), "rec", "d", options, columns, elements)[0] for elements in (None, ["rec", "p", "last"]))
        rows = lambda d: sorted(map(tuple, d.collect()), key=lambda r: r[1])
        got, want = rows(some), rows(shred(spark.createDataFrame([("d", HEAD + records(6, 300) + TAIL)], "doc_id string, xml string"), options=options).select(columns))
        begin = min(r[1] for r in want if r[5] == "rec")
        assert rows(every) == want and got == [r for r in want if r[1] < begin or r[5] in ("rec", "p", "last")]
        assert "Exchange hashpartitioning" not in some._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
