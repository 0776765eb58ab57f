"""Node tables: search, paths, navigation, indexes, edits, saving and streams."""

import pytest
from pyspark.sql import functions as F

from sylva.functions.schema import LoadOptions, SaveOptions
from sylva.operators import edit, find, index, nav, values
from sylva.plans.callbacks import named_types
from sylva.sources.save import save_io, saved_size, saved_string, to_documents, to_pieces, write_files
from sylva.sources.store import stored
from sylva.sources.xml import XmlSource, events, from_pieces, load_errors, load_under, read_files, register_sql, shred
from sylva.streaming.sax import event_counts, retained, stream_files, unless_stopped, until_stop, with_parent
from tests.documents import GARDEN, GARDEN_EVENTS, two_spaces

TYPED = LoadOptions(type_of=named_types)


def frame(spark, *texts):
    return spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc_id string, xml string")


def saved(n, options=None):
    return {r["doc_id"]: r["xml"] for r in to_documents(n, options).collect()}


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


@pytest.fixture(scope="module")
def garden(spark):
    return shred(frame(spark, GARDEN), options=TYPED).cache()


def test_garden(spark, garden):
    assert garden.count() == 39
    for wrap in (0, 72):
        written = saved(garden, SaveOptions(wrap, two_spaces))["d0"]
        assert written == GARDEN and saved(shred(frame(spark, written), options=TYPED), SaveOptions(wrap, two_spaces))["d0"] == written
    assert one(find.find_path(garden, "garden/bed/plant"))["str_value"] == "Sweet pea & bean"


def test_events(spark):
    assert {r["event"]: r["n"] for r in event_counts(events(frame(spark, GARDEN), options=TYPED)).collect()} == GARDEN_EVENTS
    e = events(frame(spark, "<a><b>x</b><c/></a>", "<a></b>"))
    assert [r["event"] for r in e.filter("doc_id = 'd0'").orderBy("seq").collect()] == ["ELEMENT_OPEN", "ELEMENT_OPEN", "DATA", "ELEMENT_CLOSE", "ELEMENT_OPEN", "ELEMENT_CLOSE", "ELEMENT_CLOSE"]
    assert e.filter("doc_id = 'd1'").count() == 1 and retained(e, F.col("event") == "DATA").count() == 1
    assert until_stop(e, F.col("name") == "b").filter("doc_id = 'd0'").count() == 2
    assert [r["doc_id"] for r in unless_stopped(e.select("doc_id").distinct(), e, F.col("name") == "b").collect()] == ["d1"]
    parents = [r["parent_seq"] for r in with_parent(e).filter("doc_id = 'd0'").orderBy("seq").collect()]
    assert parents == [None, 0, 1, 0, 0, 0, None]
    assert [tuple(r) for r in events(frame(spark, "<a/>"), columns=["event", "seq"]).orderBy("seq").collect()] == [("ELEMENT_OPEN", 0), ("ELEMENT_CLOSE", 1)]


def test_parts_of_the_node_table(spark):
    n = shred(frame(spark, "<a><b x='1'>t</b><c/></a>"), columns=["node_id", "name"], elements=["c", "b"])
    assert sorted(map(tuple, n.collect())) == [(1, "b"), (3, "c")] and n.columns == ["node_id", "name"]
    assert shred(frame(spark, "<a/>"), spread=False).count() == 1 == stored(shred(frame(spark, "<a/>"))).count()


def test_atlas(spark):
    """Paths to names that occur at several depths, index sizes, and what deleting all grandchildren leaves."""
    xml = (
        "<atlas lang='pt'><!-- north first --><sheet no='1'><name>Minho</name><legend><name>Signs</name></legend></sheet>"
        "<sheet no='2'><legend scale='10'/><town><name>Tavira</name></town><town port='no'>Loulé</town></sheet><name>Index</name></atlas>"
    )
    n = shred(frame(spark, xml), options=LoadOptions("OPAQUE")).cache()
    text = lambda path, top=None: one(find.find_path(n, path, top))["str_value"]
    root = n.filter("name = 'atlas'").select("doc_id", F.col("node_id").alias("top"))
    assert (text("name", root), text("*/name", root), text("*/legend/name", root), text("sheet/name/", root)) == ("Index", "Minho", "Signs", "Minho")
    assert one(find.find_path(n, "*/legend", root))["str_value"] is None and one(find.find_path(n, "*/legend", root))["name"] == "legend"
    second = n.filter("name = 'sheet' and ord = 2").select("doc_id", F.col("node_id").alias("top"))
    assert text("*/name", second) == text("town/name", second) == "Tavira" and one(find.find_path(n, "legend", second))["name"] == "legend"
    # The first sheet is taken and never left, though only the second has a town.
    for path in ("sheet/town", "sheet/*/town", "town", "atlas", "/name", "sheet//name", "", "*/*/name", "sheet/*", "é" * 128):
        assert find.find_path(n, path, root).collect() == []
    count = lambda *a: sum(r["n"] for r in index.index_count(index.index(n, *a)).collect())
    assert (count("name"), count("sheet", "no"), count(None, "scale"), count("town", "port"), count("river"), count()) == (4, 2, 1, 1, 0, 11)
    ind = index.index(n, "sheet", "no")
    assert [r["value"] for r in ind.orderBy("pos").collect()] == ["1", "2"] and index.index_find(ind).count() == 2
    assert one(index.index_find(ind, "sheet", "2"))["pos"] == 2 and one(index.index_reset(ind))["value"] == "1"
    rest = edit.delete(n, n.filter("depth = 2")).orderBy("node_id").collect()
    assert [(r["node_id"], r["last_desc"], r["ord"], r["name"]) for r in rest] == [(0, 4, 0, "atlas"), (1, 1, 0, None), (2, 2, 1, "sheet"), (3, 3, 2, "sheet"), (4, 4, 3, "name")]


def test_paths_never_go_back(spark):
    n = shred(frame(spark, "<?xml?><r><a/><a><b/></a></r>"))
    assert find.find_path(n, "r/a/b").count() == 0 and one(find.find_path(n, "r/*/b"))["name"] == "b"


def test_find(spark, garden):
    start = garden.filter("name = 'bed' and ord = 1").select("doc_id", F.col("node_id").alias("cur"), F.lit(0).cast("long").alias("top"))
    root = start.withColumn("cur", F.lit(0).cast("long"))
    first = one(find.find(garden, root, "bed"))["found"]
    assert first["node_id"] == one(start)["cur"]
    second = one(find.find(garden, start, "bed", descend="NONE"))["found"]
    assert second["ord"] > first["ord"] and one(find.find(garden, start, attribute="type", value="real", descend="FIRST"))["found"]["name"] == "depth"
    assert one(find.find(garden, root, "bed", descend="NONE"))["found"] is None and one(find.find(garden, root, value="b1"))["found"] is None
    inner = one(find.find(garden, start.withColumn("top", F.col("cur")), "tool"))
    assert inner["found"] is None and one(find.find(garden, start, "tool"))["found"]["depth"] == 2
    assert find.find_all(garden, attribute="type").count() == 3 and find.find_all(garden, attribute="type", value="real").count() == 1
    leaf = garden.filter("str_value like 'Sweet%'").select("doc_id", F.col("node_id").alias("cur"), F.lit(0).cast("long").alias("top"))
    assert one(find.find(garden, leaf, "note", descend="FIRST"))["found"]["name"] == "note"  # a childless start goes on after itself
    every = garden.select("doc_id", F.col("node_id").alias("cur"), F.lit(0).cast("long").alias("top"))
    found = {r["cur"]: r["found"] and r["found"]["node_id"] for r in find.find(garden, every, "tool").collect()}
    tools = [r["node_id"] for r in garden.filter("name = 'tool'").orderBy("node_id").collect()]
    assert found == {i: next((t for t in tools if t > i), None) for i in range(39)}


def test_values(spark, garden):
    at = lambda name, kind: one(values.value_of(garden, garden.filter((F.col("name") == name) & (F.col("depth") > 2)).limit(1), kind))
    assert at("depth", "REAL")["value"] == 0.25 and at("rows", "INTEGER")["value"] == 3 and at("plant", "OPAQUE")["value"] == "Sweet pea & bean"
    assert at("depth", "INTEGER")["value"] == 0 and at("depth", "OPAQUE")["value"] is None
    text = at("note", "TEXT")
    assert (text["value"], text["value_ws"]) == ("water", False)
    assert one(values.words_of(garden, garden.filter("name = 'note'")))["text"] == "water at dawn"
    own = garden.select(values.own_value("COMMENT").alias("c"), values.own_value("CDATA").alias("d")).agg(F.max("c"), F.max("d")).first()
    assert tuple(own) == (" thin out in May ", "if a < b & c")


def test_walks(spark):
    n = shred(frame(spark, "<a><b><c/></b><d/></a>", "<e/>"))
    get = lambda df, c: {(r["doc_id"], r["node_id"]): r[c] for r in df.collect()}
    k = lambda *v: {("d0", i): x for i, x in enumerate(v)} | {("d1", 0): None}
    assert get(nav.walk_next(n), "next") == k(1, 2, 3, None) and get(nav.walk_next(n, "NONE"), "next") == k(None, 3, 3, None)
    assert get(nav.walk_prev(n), "prev") == k(None, None, 1, 2) and get(nav.walk_prev(n, "NONE"), "prev") == k(None, None, 1, 1)
    assert get(nav.first_child(n), "first_child") == k(1, 2, None, None) and get(nav.last_child(n), "last_child") == k(3, 2, None, None)
    assert get(nav.next_sibling(n), "next_sibling") == k(None, 3, None, None) and get(nav.prev_sibling(n), "prev_sibling") == k(None, None, None, 1)
    top = spark.createDataFrame([("d0", 1, 2)], "doc_id string, top long, top_last long")
    assert get(nav.walk_next(n, top=top), "next") == {("d0", 1): 2, ("d0", 2): None}
    assert sorted((r["node_id"], r["ancestor"]) for r in nav.ancestors(n).collect()) == [(1, 0), (2, 0), (2, 1), (3, 0)]


def test_edits(spark):
    n = shred(frame(spark, "<a x='1'><b>one</b><c/></a>", "<a/>"), options=LoadOptions("OPAQUE")).cache()
    node = lambda name: n.filter(F.col("name") == name).select("doc_id", "node_id")
    ids = n.select("doc_id").distinct()
    new = edit.append(edit.new_node(ids, "ELEMENT", F.lit("n")), edit.new_node(ids, "INTEGER", F.lit(7)), ids.withColumn("node_id", F.lit(0).cast("long")))
    place = lambda parent, child=None: node(parent).select("doc_id", F.col("node_id").alias("parent"), F.lit(child).cast("long").alias("child"))
    assert saved(edit.add(n, new, place("a"))) == {"d0": '<a x="1"><b>one</b><c/><n>7</n></a>', "d1": "<a><n>7</n></a>"}
    assert saved(edit.add(n, new, place("a"), "BEFORE"))["d0"] == '<a x="1"><n>7</n><b>one</b><c/></a>'
    assert saved(edit.add(n, new, place("a", 3), "BEFORE"))["d0"] == '<a x="1"><b>one</b><n>7</n><c/></a>'
    assert saved(edit.add(n, new, place("a", 1), "AFTER"))["d0"] == '<a x="1"><b>one</b><n>7</n><c/></a>'
    assert saved(edit.add(n, new, place("a", 2), "BEFORE"))["d0"].startswith('<a x="1"><n>')  # a foreign child
    assert saved(edit.append(n, new, node("b"))) == {"d0": '<a x="1"><b>one<n>7</n></b><c/></a>', "d1": "<a/>"}
    rest, cut = edit.remove(n, node("b"))
    assert saved(rest)["d0"] == '<a x="1"><c/></a>' and saved(cut) == {"d0": "<b>one</b>"} and cut.filter("parent_id is null").count() == 1
    both = edit.append(rest, cut, node("a"))
    assert saved(both)["d0"] == '<a x="1"><c/><b>one</b></a>' and both.filter("name = 'b'").first()["ord"] == 1
    assert saved(edit.delete(n, node("a"))) == {}
    attrs = edit.set_attr(edit.set_attr(n, F.lit(True), "y", F.lit("<")), F.col("name") == "a", "x", F.lit("2"))
    assert saved(attrs)["d0"] == '<a x="2" y="&lt;"><b y="&lt;">one</b><c y="&lt;"/></a>'
    assert saved(edit.clear_attr(attrs, F.lit(True), "y"))["d0"] == '<a x="2"><b>one</b><c/></a>'
    value = node("b").withColumn("value", F.lit("two"))
    assert saved(edit.set_value(n, value, "OPAQUE"))["d0"] == '<a x="1"><b>two</b><c/></a>' == saved(edit.set_value(n, n.filter("node_type = 'OPAQUE'").withColumn("value", F.lit("two")), "OPAQUE"))["d0"]
    assert saved(edit.set_value(n, value, "TEXT")) == saved(n) and saved(edit.set_element(n, F.col("name") == "c", F.lit("e")))["d0"].endswith("<e/></a>")
    assert edit.set_user_data(n, F.col("name") == "b", F.create_map(F.lit("k"), F.lit("v"))).filter("user_data is not null").count() == 1
    assert saved(edit.new_xml(ids)) == {d: '<?xml version="1.0" encoding="utf-8"?>' for d in ("d0", "d1")}
    assert edit.new_node(ids, "COMMENT", F.lit(None).cast("string")).count() == 0 and saved(edit.new_node(ids, "CDATA", edit.formatted("CDATA", "%05d", F.lit(42))))["d0"] == "<![CDATA[00042]]>"


def test_saving(spark, tmp_path):
    n = shred(frame(spark, "<?xml?><!-- c --><a b='&quot;&amp;'> x <c/>y<![CDATA[<&]]></a>"))
    assert saved(n)["d0"] == '<?xml?><!-- c --><a b="&quot;&amp;"> x <c/>y<![CDATA[<&]]></a>'
    numbers = shred(frame(spark, "<a>1e20 0.1 100000 1234567 1e-5</a>"), options=LoadOptions("REAL"))
    assert saved(numbers)["d0"] == "<a>1e+20 0.1 100000 1.23457e+06 1e-05</a>"
    many = shred(frame(spark, "<a>" + " ".join(map(str, range(100))) + "</a>"), options=LoadOptions("INTEGER"))
    assert max(map(len, saved(many, SaveOptions())["d0"].split("\n"))) <= 72 + 3 and "\n" not in saved(many)["d0"]
    custom = shred(frame(spark, "<a>x</a>"), options=LoadOptions("CUSTOM", custom_load=str.upper))
    assert saved(custom) == {"d0": None} and saved(custom, SaveOptions(custom_save=lambda s: s + "!")) == {"d0": "<a>X!</a>"}
    docs = to_documents(n)
    size = len(saved(n)["d0"])
    assert [one(saved_size(docs, room))["size"] for room in (size, size + 1)] == [0, size]
    assert bytes(one(saved_string(docs, 10))["buffer"]) == saved(n)["d0"].encode()[:9]
    write_files(docs.unionByName(docs.select(F.lit("a/b").alias("doc_id"), F.lit("<x/>\n").alias("xml"))).unionByName(docs.select(F.lit("none").alias("doc_id"), F.lit(None).cast("string").alias("xml"))), str(tmp_path / "out"))
    assert {p.name: p.read_text() for p in (tmp_path / "out").iterdir()} == {"d0.xml": saved(n)["d0"] + "\n", "a%2Fb.xml": "<x/>\n"}
    assert from_pieces(to_pieces(docs, 7)).select(F.decode("xml", "UTF-8")).first()[0] == saved(n)["d0"]
    got = str(tmp_path / "got")
    save_io(docs, lambda doc_id, data: open(got, "ab").write(data) and None, 5)
    assert open(got).read() == saved(n)["d0"]


def test_edits_pass_other_documents_through(spark):
    """Documents without a target keep their rows as they are; nested targets and several in one document are one cut each."""
    n = shred(frame(spark, "<a><b><b/></b><c/><b>x</b></a>", "<a><c/></a>", "<b/>")).withColumn("node_id", F.when(F.col("doc_id") == "d1", F.col("node_id") + 10).otherwise(F.col("node_id")))
    left = edit.delete(n, n.filter("name = 'b'"))
    assert sorted((r["doc_id"], r["node_id"], r["name"]) for r in left.collect()) == [("d0", 0, "a"), ("d0", 1, "c"), ("d1", 10, "a"), ("d1", 11, "c")]
    one_each = edit.siblings(*(edit.new_node(n.select("doc_id").distinct(), "ELEMENT", F.lit(x)) for x in "pq"))
    assert [(r["node_id"], r["ord"], r["name"]) for r in one_each.filter("doc_id = 'd0'").orderBy("node_id").collect()] == [(0, 0, "p"), (1, 1, "q")]


def test_fragments(spark):
    n = shred(frame(spark, "<a><i type='integer'/><t/></a>", "<a><i type='integer'>9</i></a>"), options=TYPED)
    at = n.filter("name = 'i'").select("doc_id", "node_id")
    more = frame(spark, "1 2 <t>x y</t><!--zz-->", "<t>")
    got = saved(load_under(n, at, more, options=TYPED))
    assert got == {"d0": '<a><i type="integer">1 2<t>x y</t><!--zz--></i><t/></a>', "d1": '<a><i type="integer">9</i></a>'}


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xml").write_bytes(b"\xff\xfe" + "<a>é</a>".encode("utf-16-le"))
    (tmp_path / "in" / "b.xml").write_text("<b></c>")
    n = read_files(spark, str(tmp_path / "in"), glob="*.xml")
    assert [(r["name"], r["str_value"]) for r in n.orderBy("node_id").collect()] == [("a", None), (None, "é")]
    errors = load_errors(frame(spark, "<b>\n</c>", "<a/>", None, ""))
    assert [(r["doc_id"], r["line"], r["fatal"]) for r in errors.collect()] == [("d0", 2, True)]
    assert shred(frame(spark, None, "")).collect() == [] == shred(frame(spark, "<a>").limit(0)).collect()
    spark.dataSource.register(XmlSource)
    for push in ("false", "true"):
        spark.conf.set("spark.sql.python.filterPushdown.enabled", push)
        got = spark.read.format("sylva_xml").option("documents", "tests.test_trees:some_documents").option("parts", 3).option("value_type", "INTEGER").option("pushdown", push).load()
        assert sorted((r["doc_id"], r["int_value"]) for r in got.filter("node_type = 'INTEGER'").collect()) == [("p0", 0), ("p1", 1), ("p2", 2)]
        assert got.filter("node_type = 'ELEMENT' and name = 'a' and depth = 0").count() == 3 == got.filter("depth = 1").count()


def test_sql_function(spark):
    register_sql(spark)
    frame(spark, "<a x='1'><b>one</b></a>", None).createOrReplaceTempView("held")
    got = spark.sql("SELECT h.doc_id AS d, n.node_id, n.name, n.str_value FROM held h, LATERAL shred(h.doc_id, h.xml) n ORDER BY node_id").collect()
    assert [tuple(r) for r in got] == [("d0", 0, "a", None), ("d0", 1, "b", None), ("d0", 2, None, "one")]


def test_sql_function_of_tables(spark):
    """Whole tables by batches: rows of a null id or text have no nodes, a failed load none, repeated rows theirs each; tasks stay as they are."""
    register_sql(spark, "nodes_of")
    rows = [("d0", "<a x='1'><b>one</b></a>"), ("d0", "<a x='1'><b>one</b></a>"), (None, "<a/>"), ("d1", None), ("d2", "<a></b>"), ("d3", "")]
    spark.createDataFrame(rows, "doc_id string, xml string").repartition(3).createOrReplaceTempView("held_rows")
    got = spark.sql("SELECT doc_id, node_id, name, str_value FROM nodes_of_table(TABLE(SELECT doc_id, xml FROM held_rows))")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(2 * [("d0", 0, "a", None), ("d0", 1, "b", None), ("d0", 2, None, "one")], key=str)
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    assert spark.sql("SELECT * FROM nodes_of_table(TABLE(SELECT doc_id, xml FROM held_rows WHERE false))").count() == 0


def some_documents(part, parts):
    yield f"p{part}", b"<a>%d</a>" % part


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.xml").write_text(f"<a><b>{i}</b></a>")
    counts = event_counts(stream_files(spark, str(tmp_path / "in"), per_trigger=1))
    q = counts.writeStream.outputMode("complete").format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {r["event"]: r["n"] for r in spark.table("counted").collect()} == {"ELEMENT_OPEN": 6, "ELEMENT_CLOSE": 6, "DATA": 3}


def test_null_and_repeated_ids(spark):
    """Rows without id, or of one id, are documents of their own, or are left out and listed: for loads, searches, edits and saving."""
    from sylva.operators.batch import apply_edits
    from sylva.sources.xml import SEPARATOR, with_unique_ids

    given = [(None, "<a><x/></a>"), (None, "<b/>"), ("k", "<c/>"), ("k", "<d><y/></d>"), ("k", "<c/>"), ("m", "<e>t</e>"), ("m" + SEPARATOR, "<f/>"), ("", "<g/>"), ("n", None), ("o", "<h></i>"), (None, None)]
    docs = spark.createDataFrame(given, "doc_id string, xml string").repartition(3)
    n = stored(shred(docs, ids="number"))
    assert sorted(r["xml"] for r in to_documents(n).collect()) == sorted(x for _, x in given if x and x != "<h></i>")
    names = {r["name"]: r["doc_id"] for r in n.filter("parent_id is null").collect()}
    assert names["e"] == "m" and names["f"] == "m" + 2 * SEPARATOR and names["g"] == "" and names["d"].startswith("k" + SEPARATOR) and names["a"].startswith(SEPARATOR)
    roots = n.filter("node_id = 0").select("doc_id", F.col("node_id").alias("cur"), F.col("node_id").alias("top"))
    found = find.find(n, roots).filter("found is not null").collect()
    assert {r["doc_id"]: r["found"]["name"] for r in found} == {names["a"]: "x", names["d"]: "y"}
    log = roots.select("doc_id", F.lit(0).alias("seq"), F.lit("NEW").alias("op"), F.lit(-1).alias("node"), F.lit(0).alias("parent"), F.lit("ELEMENT").alias("node_type"), F.lit("new").alias("name"))
    edited = apply_edits(n, log, values=False)
    assert sorted(r["xml"] for r in to_documents(edited).collect()) == sorted(["<a><x/><new/></a>", "<d><y/><new/></d>", "<e>t<new/></e>", *(f"<{x}><new/></{x}>" for x in "bccfg")])
    left = shred(docs, ids="reject")
    assert sorted(r["name"] for r in left.filter("parent_id is null").collect()) == ["e", "f", "g"]
    errors = lambda ids: sorted((r["doc_id"], r["line"]) for r in load_errors(docs, ids=ids).filter("doc_id is not null").collect())
    assert errors("reject") == [("k", 0)] * 3 + [("o", 1)] and errors("unique") == [("o", 1)] and errors("number") == [("o", 1)]
    assert load_errors(docs).filter("doc_id is null and fatal and line = 0").count() == 3 and load_errors(docs, ids="number").count() == 1
    assert events(docs, ids="number").filter("event = 'ELEMENT_OPEN'").count() == 11 and with_unique_ids(docs).select("doc_id").distinct().count() == len(given)
    with pytest.raises(ValueError):
        shred(docs, ids="any")
