"""Quality rules as a bitmask ledger.

Every rule is evaluated once; the ledger stores its measurements and one failure bit a rule. Policies, each a
version with the rules that reject, and ablations are bit operations on what is stored. Built-in functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.llm.shared import BLANKS, Tables

SYMBOLS = "#*$%&|<>"
RUN = 5
BULLETS = ("-", "*", "•")

#: Rules in the order of their bits: name, and the condition on the measurements under which a document fails.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_runs": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > 3 * word_chars",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "giant_word": "longest_word > 1000",
    "few_letters": "2 * n_letters < word_chars",
    "capitals": "2 * n_upper > n_letters",
    "bullets": "10 * n_bullet_lines > 9 * n_lines",
    "ellipses": "10 * n_ellipsis_lines > 3 * n_lines",
    "repeated_line_chars": "5 * dup_line_chars > 2 * text_chars",
}
MEASUREMENTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "text_chars", "n_letters", "n_upper", "longest_word", "n_bullet_lines", "n_ellipsis_lines", "dup_line_chars"]


@dataclass(frozen=True)
class Policy:
    """A version of which rules reject; the other rules are only recorded."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(r) for r in self.rules)


BASE = Policy("base", ("few_words", "repeated_runs"))
PRODUCTION = Policy("production-2", tuple(RULES))


def measure(docs: DataFrame, *carry: str) -> DataFrame:
    """doc_id, the columns of `carry` and MEASUREMENTS for each row of docs (doc_id, text); null text has one empty line and no words.

    Words in repeated runs: hashes of all runs of RUN words; where some are equal, they are sorted with their places, so
    equal ones are neighbours, and each place of those adds the words up to the next such place, RUN at most.
    """
    less = lambda c, chars: F.translate(c, chars, "")
    text, words, lines = F.col("_text"), F.col("_words"), F.col("_lines")
    without = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    some = lambda test: F.size(F.filter("_full", lambda x: test(F.btrim(x, F.lit(BLANKS)))))
    joined = lambda c: F.length(F.array_join(c, ""))
    bare = F.btrim(text, F.lit(BLANKS))
    d = docs.select("doc_id", *carry, F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    d = d.withColumns({"_words": F.when(F.length(bare) > 0, F.split(bare, "[ \\t-\\r]+")).otherwise(F.array().cast("array<string>")), "_lines": F.split(text, "\n", -1)})
    d = d.withColumns({"_full": F.filter("_lines", lambda x: less(x, BLANKS) != ""), "_hashed": F.transform("_words", lambda w: F.xxhash64(w))})
    some_runs = F.transform(F.sequence(F.lit(0), F.size(words) - RUN), lambda i: F.xxhash64(*(F.get("_hashed", i + k) for k in range(RUN))))
    d = d.withColumn("_runs", F.when(F.size(words) >= RUN, some_runs).otherwise(F.array().cast("array<bigint>")))
    pairs = F.sort_array(F.transform("_runs", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("_pairs", F.when(F.size(F.array_distinct("_runs")) < F.size("_runs"), pairs))
    twin = lambda x, i: x["h"].eqNullSafe(F.get("_pairs", i + 1)["h"]) | x["h"].eqNullSafe(F.get("_pairs", i - 1)["h"])
    d = d.withColumn("_places", F.sort_array(F.transform(F.filter("_pairs", twin), lambda x: x["i"])))
    adds = F.transform("_places", lambda p, i: F.least(F.lit(RUN), F.coalesce(F.get("_places", i + 1) - p, F.lit(RUN))))
    as_long = lambda c: c.cast("long")
    return d.select(
        "doc_id", *carry,
        as_long(F.size(words)).alias("n_words"),
        as_long(F.length(less(text, BLANKS))).alias("word_chars"),
        as_long(F.length(text) - F.length(less(text, SYMBOLS))).alias("n_symbols"),
        as_long(F.size(lines)).alias("n_lines"),
        as_long(F.size("_full") - F.size(F.array_distinct("_full"))).alias("n_dup_lines"),
        as_long(F.coalesce(F.aggregate(adds, F.lit(0), lambda a, x: a + x), F.lit(0))).alias("n_repeat_words"),
        as_long(F.length(text)).alias("text_chars"),
        as_long(without("\\p{L}+")).alias("n_letters"),
        as_long(without("\\p{Lu}+")).alias("n_upper"),
        as_long(F.coalesce(F.array_max(F.transform(words, F.length)), F.lit(0))).alias("longest_word"),
        as_long(some(lambda x: F.substring(x, 1, 1).isin(*BULLETS))).alias("n_bullet_lines"),
        as_long(some(lambda x: x.endswith("...") | x.endswith("…"))).alias("n_ellipsis_lines"),
        as_long(joined("_full") - joined(F.array_distinct("_full"))).alias("dup_line_chars"),
    )


def ledger(docs: DataFrame, *carry: str) -> DataFrame:
    """measure()'s columns and failures, a long whose bit i is set if rule i of RULES fails. One row for each row of docs; no shuffle."""
    bits = [F.when(F.expr(rule), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, rule in enumerate(RULES.values())]
    failures = bits[0]
    for bit in bits[1:]:
        failures = failures.bitwiseOR(bit)
    # A row number in the expression keeps filters on failures above this projection; pushed below, they would repeat the measuring.
    return measure(docs, *carry).withColumn("failures", F.when(F.monotonically_increasing_id() >= 0, failures))


def stored(rows: DataFrame) -> DataFrame:
    """The ledger written and read again: policies and ablations of any number then read bits and measurements, and no text."""
    return Tables(rows.sparkSession, "quality").keep(rows, "ledger")


def judge(rows: DataFrame, policy: Policy = PRODUCTION) -> DataFrame:
    """The ledger's rows with base_failed, kept and the policy's version."""
    failed = lambda p: F.col("failures").bitwiseAND(F.lit(p.mask).cast("long")) != 0
    return rows.withColumns({"base_failed": failed(BASE), "kept": ~failed(BASE) & ~failed(policy), "policy": F.lit(policy.version)})


def ablations(rows: DataFrame, *policies: Policy) -> DataFrame:
    """version, rule, rejected (rows the policy rejects), by_rule (that fail the rule), by_rule_alone (that dropping the rule would keep).

    Rows are first counted by their failure bits: at most 2**len(RULES) counts, however many documents.
    """
    counts = rows.groupBy("failures").agg(F.count("*").alias("n"))
    cases = F.array(*(F.struct(F.lit(p.version).alias("version"), F.lit(r).alias("rule"), F.lit(p.mask).cast("long").alias("mask"), F.lit(1 << list(RULES).index(r)).cast("long").alias("bit")) for p in policies for r in p.rules))
    each = counts.select("failures", "n", F.explode(cases).alias("c")).select("failures", "n", "c.*")
    hit = F.col("failures").bitwiseAND(F.col("mask"))
    some = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return each.groupBy("version", "rule").agg(some(hit != 0).alias("rejected"), some(F.col("failures").bitwiseAND(F.col("bit")) != 0).alias("by_rule"), some(hit == F.col("bit")).alias("by_rule_alone"))
