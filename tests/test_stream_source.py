"""The stream reader of sylva_xml: two triggers, restarts, a failure in between; each document once."""

from __future__ import annotations

import os

import pytest

from sylva.sources.xml import XmlSource, shred


def put(at, i, text=None):
    (at / f"{i}.xml").write_text(text if text is not None else f"<a k='{i}'><b>{'x ' * i}</b></a>")


def run(spark, tmp_path, documents="between", parts=3, **more):
    stream = spark.readStream.format("sylva_xml").option("documents", f"tests.stream_documents:{documents}").option("latest", "tests.stream_documents:latest").option("done", "tests.stream_documents:done")
    for name, value in {"at": str(tmp_path / "in"), "parts": parts, **more}.items():
        stream = stream.option(name, value)
    q = stream.load().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
    q.awaitTermination(120)


def rows(df):
    return sorted(map(repr, df.collect()))


def wanted(spark, at, first=0):
    n = len([f for f in os.listdir(at) if f.endswith(".xml")])
    texts = [(f"d{i}", (at / f"{i}.xml").read_text()) for i in range(first, n)]
    return rows(shred(spark.createDataFrame([(d, None if t == "null" else t) for d, t in texts], "doc_id string, xml string")))


def test_triggers_restarts_and_a_failure(spark, tmp_path):
    spark.dataSource.register(XmlSource)
    at = tmp_path / "in"
    at.mkdir()
    for i in range(4):
        put(at, i)
    run(spark, tmp_path)
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == wanted(spark, at)
    put(at, 4, "null"), put(at, 5, "<a><b/>w </a>"), put(at, 6, ""), put(at, 7, "<a></b>"), put(at, 8, "<?xml?><last/>")
    (at / "broken").touch()
    with pytest.raises(Exception, match="not now"):
        run(spark, tmp_path, "failing")
    (at / "broken").unlink()
    put(at, 9)  # comes while the query is down: the failed batch is read again as it was, then this one
    run(spark, tmp_path, "failing")
    run(spark, tmp_path)  # nothing new
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == wanted(spark, at)
    told = [int(x) for x in (at / "done").read_text().split()]
    assert told == sorted(told) and told[-1] <= 10


def test_a_later_start_and_more_parts_than_documents(spark, tmp_path):
    spark.dataSource.register(XmlSource)
    at = tmp_path / "in"
    at.mkdir()
    for i in range(5):
        put(at, i)
    run(spark, tmp_path, parts=16, start=2)
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == wanted(spark, at, 2)


def test_balances_are_written_as_the_sql_writes_them(spark, tmp_path):
    """A negative zero keeps its sign, and ties go by the binary value."""
    import duckdb

    from sylva.plans.queries import oracle_sql, queries

    rows = [(1, "a", 1, -0.0, "X"), (2, "b", 2, 0.125, "X"), (3, "c", 3, 1.005, "X"), (4, "d", 4, -12.5, "X")]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    got = queries()["stream_source"](spark, str(tmp_path)).select("doc", "n_nodes", "balance", "batch").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(oracle_sql()["stream_source"]).fetchall())
