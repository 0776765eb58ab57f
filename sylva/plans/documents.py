"""Documents made from the tables: one an order, with its items; one of each document's text; one an event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.plans.callbacks import joined_files
from sylva.sources.save import escape
from sylva.sources.store import scratch

#: Items of an order in a fixed order: the line number is not unique, whole rows are.
ITEM_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, xml: `<?xml?><order id status><item line part flag><qty>..</qty><price>..</price></item>...</order>` of every order.

    Items are gathered by order before the join, which so shuffles one row an order. They are dealt out by order as rows, and made markup where they
    are together: gathering lists before that sorts them twice, as an order's items lie apart. Their size tells nothing of the texts', so the
    join is one by sorting: a broadcast would hold the items of all orders.
    """
    each = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(*ITEM_ORDER).alias("i")).repartition("l_orderkey")
    held = each.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("i")).alias("all")).select("l_orderkey", _items("all").alias("items"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    xml = F.concat(F.lit('<?xml version="1.0"?>'), _order(F.col("o_orderkey"), F.col("o_orderstatus"), F.coalesce("items", F.lit(""))))
    return o.join(held.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").cast("string").alias("doc_id"), xml.alias("xml"))


def _part(name: str, value: Column) -> Column:
    return F.concat(F.lit(f' {name}="'), value, F.lit('"'))


def _order(key: Column, status: Column, items: Column) -> Column:
    return F.concat(F.lit("<order"), _part("id", key.cast("string")), _part("status", escape(status)), F.lit(">"), items, F.lit("</order>"))


def _items(all_: str) -> Column:
    """The markup of an order's items, from their rows in order."""
    whole = lambda value: value.cast("string")
    cents = lambda i: F.round(i["l_extendedprice"] * 100).cast("long")
    item = lambda i: F.concat(F.lit("<item"), _part("line", whole(i["l_linenumber"])), _part("part", whole(i["l_partkey"])), _part("flag", escape(i["l_returnflag"])), F.lit("><qty>"), whole(i["l_quantity"].cast("long")), F.lit("</qty><price>"), whole(cents(i)), F.lit("</price></item>"))
    return F.array_join(F.transform(all_, item), "")


def journal(spark: SparkSession, sf_dir: str, path: str) -> str:
    """One file of all orders' documents, by their keys, as records of one element: `<?xml?><orders>`, an order a line, `</orders>`. Its path."""
    # Orders and their items are dealt out by ranges of the key, once, and made markup where they are; then one file's one writer streams the sorted parts into it.
    row = F.struct(*ITEM_ORDER)
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), row.alias("i"), F.lit(None).cast("struct<status: string>").alias("o"))
    heads = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.lit(None).cast(items.schema["i"].dataType).alias("i"), F.struct(F.col("o_orderstatus").alias("status")).alias("o"))
    held = items.unionByName(heads).repartitionByRange("key").groupBy("key").agg(F.sort_array(F.collect_list("i")).alias("all"), F.collect_list("o").alias("of")).select("key", "all", F.explode("of").alias("o"))
    lines = held.select("key", _order(F.col("key"), F.col("o.status"), _items("all")).alias("value")).sortWithinPartitions("key").select("value")
    parts = scratch(spark)
    lines.write.option("compression", "zstd").parquet(parts)
    spark.range(1).coalesce(1).mapInArrow(joined_files(parts, f"{path}/part-00000.txt", '<?xml version="1.0"?><orders>\n', "</orders>\n"), "id long").count()
    return path


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, xml: `<?xml?><doc lang>text</doc>` of every document."""
    return as_texts(table(spark, sf_dir, "documents"))


def as_texts(d: DataFrame) -> DataFrame:
    """The same of a table or stream of documents."""
    xml = F.concat(F.lit('<?xml version="1.0"?><doc lang="'), escape(F.col("lang")), F.lit('">'), escape(F.coalesce("text", F.lit(""))), F.lit("</doc>"))
    return d.select(F.col("doc_id").cast("string").alias("doc_id"), xml.alias("xml"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, xml: `<?xml?><event type><at>time</at><note>props</note></event>` of every event."""
    e = table(spark, sf_dir, "events")
    xml = F.concat(F.lit('<?xml version="1.0"?><event type="'), escape(F.col("event_type")), F.lit('"><at>'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("</at><note>"), escape(F.col("props")), F.lit("</note></event>"))
    return e.select(F.col("event_id").cast("string").alias("doc_id"), xml.alias("xml"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, xml: every customer as a document that holds each kind of node:

    `<?xml?><!DOCTYPE customer><customer id nation><!-- name --><![CDATA[segment <&>]]><?seen id?><name>..</name><balance>..</balance><segment>..</segment></customer>`
    """
    c = table(spark, sf_dir, "customer")
    key, nation = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    parts = ['<?xml version="1.0"?><!DOCTYPE customer><customer id="', key, '" nation="', nation, '"><!-- ', F.col("c_name"), " --><![CDATA[", F.col("c_mktsegment"), " <&>]]><?seen ", key]
    parts += ["?><name>", F.col("c_name"), "</name><balance>", F.col("c_acctbal").cast("string"), "</balance><segment>", F.col("c_mktsegment"), "</segment></customer>"]
    return c.select(key.alias("doc_id"), F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)).alias("xml"))


#: One way to break a document for each rule of loading: what comes before the line breaks, what after them, and the errors (message, fatal) of its load.
BROKEN: list[tuple[str, str, list[tuple[str, bool]]]] = [
    ("<?xml?>", "<a>&nope;</a>", [("Entity &nope; is not known", True)]),
    ("<?xml?>", "<a>&amp x</a>", [("Entity &amp is not terminated", True)]),
    ("<?xml?>", "<a>&" + "n" * 64 + ";</a>", [("Entity name too long", True)]),
    ("<?xml?>", "<a>&#1;</a>", [("Bad control character 0x01 in an entity", True)]),
    ("<?xml?>", "<a>&#xD800;</a>", [("Entity &#xD800; is no character", True)]),
    ("<?xml?>", "<a>\x01</a>", [("Bad control character 0x01", False), ("Close tag </a> is missing", True)]),
    ("<?xml?>", "<a <c/>", [("Bare < in <a>", True)]),
    ("<?xml?>", "<a<b/>", [("Bare < in a tag", True)]),
    ("<?xml?>", "<a+b/>", [("", True)]),
    ("<?xml?>", "<a><!-- x", [("The text ends in a comment", True)]),
    ("<?xml?>", "<a><![CDATA[x", [("The text ends in a cdata", True)]),
    ("<?xml?>", "<a><?x", [("The text ends in a directive", True)]),
    ("<?xml?>", "<a><!x", [("The text ends in a declaration", True)]),
    ("<?xml?>", "<a></b>", [("Close tag </b> doesn't match <a>", True)]),
    ("<?xml?>", "<a/x>", [("'>' expected after <a/", True)]),
    ("<?xml?>", "<a b='1' /x>", [("'>' expected after '/' in <a>", True)]),
    ("<?xml?>", "<a><b>", [("Close tag </b> is missing", True)]),
    ("<?xml?>", "<a b='1' b='2'/>", [("Attribute 'b' of <a> is given twice", True)]),
    ("<?xml?>", "<a b/>", [("Attribute 'b' of <a> has no value", True)]),
    ("<?xml?>", "<a 'b'='1'/>", [("An attribute of <a> has no value", True)]),
    ("<?xml?>", "<custom>x</custom>", [("A value of type CUSTOM can't be added to <custom>", True)]),
    ("<?xml?>", "<integer>12x</integer>", [("Bad integer value '12x' in <integer>", False), ("Close tag </integer> is missing", True)]),
    ("<?xml?>", "<real>1.5z</real>", [("Bad real value '1.5z' in <real>", False), ("Close tag </real> is missing", True)]),
    ("<a/>", "<b/>", [("<b> can't be a second root", True)]),
    ("<a/>", "<!--xx-->", [("A comment can't be a second root", True)]),
    ("<a/>", "<![CDATA[x]]>", [("A cdata can't be a second root", True)]),
    ("<a/>", "<?x?>", [("A directive can't be a second root", True)]),
    ("<a/>", "<!x>", [("A declaration can't be a second root", True)]),
    ("<?xml?>", "<a>whole</a>", []),
]


def broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, xml: a document for each customer, broken in one of the ways of BROKEN, by turns, after as many line breaks as its nation's key."""
    c = table(spark, sf_dir, "customer")
    turn = (F.col("c_custkey") % len(BROKEN)).cast("int")
    side = lambda i: F.get(F.array(*(F.lit(b[i]) for b in BROKEN)), turn)
    return c.select(F.col("c_custkey").cast("string").alias("doc_id"), F.concat(side(0), F.repeat(F.lit("\n"), F.col("c_nationkey")), side(1)).alias("xml"))


def long_id(c: str = "doc_id") -> Column:
    return F.col(c).cast("long")
