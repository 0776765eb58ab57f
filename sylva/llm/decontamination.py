"""Benchmark decontamination by a distributed positional inverted index.

The index holds a posting (term, doc, pos) for every word of the training texts. It is cut by documents: each task writes the
postings of its own documents, in lists by term, so building it shuffles nothing and no term is too frequent. A search fetches the
lists of the test terms, orders the words of each test window by how often they occur, and intersects the lists with their
offsets taken off, from the rarest term on: the two rarest first, the others only where those two meet.
Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylva.llm.shared import Tables

#: What lies between words, before A-Z are lower-cased: all ASCII but digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str | Column) -> Column:
    """The words of a text as they stand; null has none."""
    return F.array_remove(F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), BETWEEN), "")


def lowered(word: Column) -> Column:
    """A-Z in lower case and nothing else; words of ASCII alone by the faster function."""
    return F.when(F.length(word) == F.octet_length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def build_index(docs: DataFrame, tables: Tables) -> DataFrame:
    """The stored index of docs (doc_id, text): term, doc, pos; and for each row of docs one row without term, with doc_id and n_words.

    doc numbers the rows of docs, so rows with one doc_id, or none, are documents of their own. Null and empty texts have no
    postings. Other columns are left. Each task writes its own documents' lists; nothing is shuffled.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("doc"), F.col("doc_id").cast("long").alias("id"), words("text").alias("words"))
    # A null first: the document's own row.
    each = rows.select("doc", "id", F.size("words").alias("n"), F.posexplode(F.concat(F.array(F.lit(None).cast("string")), "words")).alias("at", "word"))
    own = F.col("at") == 0
    postings = each.select(lowered(F.col("word")).alias("term"), "doc", (F.col("at") - 1).alias("pos"), F.when(own, F.col("id")).alias("doc_id"), F.when(own, F.col("n").cast("long")).alias("n_words"))
    return tables.keep(postings.sortWithinPartitions(F.xxhash64("term")), "index")


def documents(index: DataFrame) -> DataFrame:
    """doc, doc_id, n_words of every row that was indexed."""
    return index.filter("term is null").select("doc", "doc_id", "n_words")


def test_windows(items: DataFrame, length: int, tables: Tables) -> DataFrame:
    """wid, n, words, items: the distinct windows of so many words of the items (item_id, text), with the ids of the items that hold each, as strings.

    An item of fewer words is one window; one without words has none. Items without id hit words, but are in no list of items.
    """
    each = items.select(F.col("item_id").cast("string").alias("item"), words(F.translate("text", _UPPER, _LOWER)).alias("w")).filter(F.size("w") > 0)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - length + 1, F.lit(1))), lambda i: F.slice("w", i, length))
    made = each.select("item", F.explode(cut).alias("words")).groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return tables.keep(made.select(F.monotonically_increasing_id().alias("wid"), F.size("words").alias("n"), "words", "items"), "windows")


def _meet(wanted: DataFrame, lists: DataFrame, slop: int) -> DataFrame:
    """Rows of wanted (tid, doc, at, ..) for each posting of the term in that document at most `slop` words from at, with `off_by`."""
    if not slop:
        return wanted.join(lists.withColumnRenamed("pos", "at"), ["tid", "doc", "at"]).withColumn("off_by", F.lit(0))
    span = slop + 1
    cell = lambda x: F.floor(x / span)
    cells = wanted.withColumn("cell", F.explode(F.sequence(cell(F.col("at") - slop), cell(F.col("at") + slop))))
    met = cells.join(lists.withColumn("cell", cell(F.col("pos"))), ["tid", "doc", "cell"])
    return met.withColumn("off_by", F.abs(F.col("pos") - F.col("at"))).filter(F.col("off_by") <= slop).drop("cell", "pos")


def search(index: DataFrame, windows: DataFrame, tables: Tables, slop: int = 0) -> DataFrame:
    """wid, doc, start, off_by: where the windows stand in the indexed texts.

    slop 0: exact phrases. More: proximity matches, in which the window's rarest word stands at its place (start is that place less
    its offset, so may be negative) and each other word at most `slop` words from its own; off_by is the sum of the least distances.
    Rarest: by the number of postings, ties by the term, then by the place in the window.
    """
    terms = tables.keep(windows.select(F.explode("words").alias("term")).distinct().select("term", F.monotonically_increasing_id().alias("tid")), f"terms{slop}")
    lists = tables.keep(index.filter("term is not null").select("term", "doc", "pos").join(terms, "term").select("tid", "doc", "pos"), f"lists{slop}")
    counted = lists.groupBy("tid").agg(F.count("*").alias("df")).join(terms, "tid")
    each = windows.select("wid", "n", F.posexplode("words").alias("off", "term")).join(counted, "term")
    ranked = each.groupBy("wid", "n").agg(F.sort_array(F.collect_list(F.struct("df", "term", "off", "tid"))).alias("t")).filter(F.size("t") == F.col("n"))
    ranked = tables.keep(ranked.select("wid", "n", F.transform("t", lambda t: F.struct(t["tid"].alias("tid"), t["off"].alias("off"))).alias("t")), f"ranked{slop}")
    first, second = F.get("t", F.lit(0)), F.get("t", F.lit(1))
    alone = lists.join(ranked.filter("n = 1").select("wid", first["tid"].alias("tid")), "tid").select("wid", "doc", F.col("pos").alias("start"), F.lit(0).cast("long").alias("off_by"))
    more = ranked.filter("n > 1").select("wid", "n", "t", first["tid"].alias("tid"), second["tid"].alias("tid2"), (second["off"] - first["off"]).alias("step"), first["off"].alias("off1"))
    # Windows whose two rarest words are the same at the same distance are looked for as one.
    pairs = more.select("tid", "tid2", "step").distinct()
    begun = lists.join(pairs, "tid").select(F.col("tid2").alias("tid"), "doc", (F.col("pos") + F.col("step")).alias("at"), F.col("tid").alias("tid1"), "step")
    begun = begun if slop else begun.filter("at >= 0")
    met = _meet(begun, lists.join(pairs.select(F.col("tid2").alias("tid")).distinct(), "tid", "left_semi"), slop)
    if slop:
        met = met.groupBy("tid", "doc", "at", "tid1", "step").agg(F.min("off_by").alias("off_by"))
    met = met.select(F.col("tid").alias("tid2"), F.col("tid1").alias("tid"), "step", "doc", (F.col("at") - F.col("step")).alias("pos"), "off_by")
    both = tables.keep(met.join(more, ["tid", "tid2", "step"]).select("wid", "n", "doc", (F.col("pos") - F.col("off1")).alias("start"), "off_by", "t"), f"pairs{slop}")
    rest = both.filter("n > 2").select("wid", "n", "doc", "start", F.col("off_by").alias("before"), F.explode(F.slice("t", 3, 1 << 30)).alias("t"))
    rest = rest.select("wid", "n", "doc", "start", "before", F.col("t.off").alias("off"), F.col("t.tid").alias("tid"), (F.col("start") + F.col("t.off")).alias("at"))
    theirs = tables.keep(both.filter("n > 2").select("doc").distinct(), f"docs{slop}")
    met = _meet(rest, lists.join(theirs, "doc", "left_semi"), slop)
    key = ["wid", "n", "doc", "start", "before"]
    if slop:
        met = met.groupBy(*key, "off").agg(F.min("off_by").alias("off_by"))
    whole = met.groupBy(*key).agg(F.count("*").alias("met"), F.sum("off_by").alias("off_by")).filter("met = n - 2")
    whole = whole.select("wid", "doc", "start", (F.col("off_by") + F.col("before")).alias("off_by"))
    return whole.unionByName(both.filter("n = 2").select("wid", "doc", "start", F.col("off_by").cast("long"))).unionByName(alone)


def decontaminate(docs: DataFrame, items: DataFrame, length: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of docs (doc_id, text), and items, the ids themselves.

    A word is hit if it lies in an occurrence of a window of `length` words of an item; items with an occurring window are counted and
    listed, sorted as strings. Null and empty texts have no words; a row without doc_id, or of a repeated one, is a document of its
    own; equal items are one window each with all their ids; an empty table of items hits nothing. Other columns are left.
    """
    tables = Tables(docs.sparkSession, "decontamination")
    index, windows = build_index(docs, tables), test_windows(items, length, tables)
    found = tables.keep(search(index, windows, tables).join(windows.select("wid", "n", "items"), "wid").select("doc", "start", "n", "items"), "found")
    before = Window.partitionBy("doc").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.groupBy("doc", "start").agg(F.max("n").alias("n")).withColumn("end", F.col("start") + F.col("n"))
    fresh = F.greatest(F.col("end") - F.greatest(F.col("start"), F.coalesce(F.max("end").over(before), F.lit(0))), F.lit(0))
    hit = spans.withColumn("fresh", fresh).groupBy("doc").agg(F.sum("fresh").alias("hit"))
    held = found.groupBy("doc").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("held"))
    rows = documents(index).join(hit.join(held, "doc"), "doc", "left")
    ids = F.coalesce("held", F.array().cast("array<string>"))
    n_hit = F.coalesce(F.col("hit").cast("long"), F.lit(0).cast("long"))
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), ids.alias("items"))


def near_items(docs: DataFrame, items: DataFrame, length: int = 10, slop: int = 2) -> DataFrame:
    """doc_id, item_id (as a string), n_places, off_by: each document with each item of which a window stands there with every word at most `slop` words from its place.

    n_places: how many places of windows; off_by: the least sum of distances, 0 for an exact phrase. Rows without doc_id are
    documents of their own; items without id are left out.
    """
    tables = Tables(docs.sparkSession, "proximity")
    index, windows = build_index(docs, tables), test_windows(items, length, tables)
    found = search(index, windows, tables, slop).join(windows.select("wid", F.explode("items").alias("item_id")), "wid")
    each = found.groupBy("doc", "item_id").agg(F.count("*").alias("n_places"), F.min("off_by").cast("long").alias("off_by"))
    return each.join(documents(index), "doc").select("doc_id", "item_id", "n_places", "off_by")
