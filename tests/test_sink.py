"""The file sink: what is seen of writes that succeed, fail, and come again."""

from __future__ import annotations

import os
import shutil

import pytest
from pyspark.sql import functions as F

from sylva.sources.save import XmlSink, file_name, write_files


def seen(path) -> dict[str, str]:
    return {f: (path / f).read_text() for f in os.listdir(path) if not f.startswith(".")} if path.exists() else {}


def test_commit_and_abort(spark, tmp_path):
    good = spark.range(40).select(F.col("id").cast("string").alias("doc_id"), F.concat(F.lit("<a>"), "id", F.lit("</a>")).alias("xml")).repartition(4)
    write_files(good.unionByName(spark.createDataFrame([("none", None), ("ö/1", "<b/>\n")], "doc_id string, xml string")), str(tmp_path / "out"))
    want = {f"{i}.xml": f"<a>{i}</a>\n" for i in range(40)} | {file_name("ö/1"): "<b/>\n"}
    assert seen(tmp_path / "out") == want and [f for f in os.listdir(tmp_path / "out") if f.startswith(".")] == []
    bad = good.withColumn("xml", F.when(F.col("doc_id") == "33", F.raise_error(F.lit("no"))).otherwise(F.lit("<new/>")))
    with pytest.raises(Exception, match="no"):
        write_files(bad, str(tmp_path / "out"))
    assert seen(tmp_path / "out") == want and [f for f in os.listdir(tmp_path / "out") if f.startswith(".")] == []
    with pytest.raises(Exception, match="no"):
        write_files(bad, str(tmp_path / "never"))
    assert seen(tmp_path / "never") == {}


def test_an_epoch_given_twice(spark, tmp_path):
    spark.dataSource.register(XmlSink)
    source, out, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"

    def add(i):
        spark.createDataFrame([(f"d{i}", f"<x>{i}</x>")], "doc_id string, xml string").coalesce(1).write.mode("append").parquet(str(source))

    def run():
        stream = spark.readStream.schema("doc_id string, xml string").parquet(str(source))
        q = stream.writeStream.format("sylva_xml_files").option("path", str(out)).option("checkpointLocation", str(state)).trigger(availableNow=True).start()
        assert q.awaitTermination(60) and q.exception() is None

    add(0)
    run()
    add(1)
    run()
    assert seen(out) == {"d0.xml": "<x>0</x>\n", "d1.xml": "<x>1</x>\n"} and sorted(os.listdir(out / ".epochs")) == ["0", "1"]
    # As if the query had died after the sink's commit and before its own: the last epoch is given again.
    os.remove(out / "d1.xml")
    for f in os.listdir(state / "commits"):
        if f.strip(".").split(".")[0] == "1":
            os.remove(state / "commits" / f)
    run()
    assert seen(out) == {"d0.xml": "<x>0</x>\n"} and sorted(f for f in os.listdir(out) if f.startswith(".")) == [".epochs"]
    shutil.rmtree(out / ".epochs")
