"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression over host + path with the literal tokens that every match must hold. The index keeps
each rule under the one of its tokens that is rarest among the URLs' tokens; a URL's tokens fetch candidate rules,
and only those run their expressions. Built-in functions only.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many (token, rule) rows are broadcast; a larger index is joined by a shuffle on the token.
BROADCAST_RULES = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """name: what is reported; pattern: Java regular expression, found anywhere in host + path; tokens: lower-case runs of [0-9a-z] in every match that no such character adjoins there; rank: the highest of the rules that match decides."""

    name: str
    action: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int


def site_rule(action: str, prefix: str) -> Rule:
    """A rule on a host with its subdomains and on how the path starts, like example.net/en/. A longer prefix wins."""
    host, slash, path = prefix.partition("/")
    tokens = re.findall("[0-9a-z]+", host) + [*re.findall("[0-9a-z]+(?=[^0-9a-z])", (slash + path).lower())]
    quoted = re.sub(r"([^0-9A-Za-z/_-])", r"\\\1", prefix)
    return Rule(prefix, action, f"^(?:[^/]*\\.)?{quoted}", tuple(tokens), 1_000 + len(prefix))


def word_rule(action: str, *tokens: str) -> Rule:
    """A rule on tokens that follow each other in host or path, parted by one other character."""
    inner = "[^0-9a-z]".join(tokens)
    return Rule("-".join(tokens), action, f"(?i)(?:^|[^0-9a-z]){inner}(?:[^0-9a-z]|$)", tokens, len(inner) % 1_000)


#: The four site rules that are asked for.
SITES = (site_rule("block", "net/"), site_rule("allow", "example.net/en/"), site_rule("block", "example.com/de/"), site_rule("allow", "org/fr/"))
#: The rules that decide where none of those fits: every offer before every ware, one word alone, and traces of what is no page.
OFFERS = ("adult", "best", "bulk", "buy", "cheap", "discount", "easy", "fast", "free", "hot", "instant", "miracle", "online", "replica", "secret", "spam", "win")
WARES = ("bitcoin", "casino", "cialis", "dating", "essays", "farm", "followers", "jackpot", "loans", "lottery", "pills", "poker", "prizes", "slots", "viagra", "watches")
TRACES = (("/wp-login\\.php$", ("wp", "login", "php")), ("/xmlrpc\\.php$", ("xmlrpc", "php")), ("/[0-9]{1,3}x[0-9]{1,3}\\.gif$", ("gif",)), ("/[0-9a-f]{32}/sid(?:/|$)", ("sid",)), ("/cgi-bin/[^/]*\\.exe$", ("cgi", "bin", "exe")))
SPAM = (*(word_rule("block", a, b) for a in OFFERS for b in WARES), word_rule("block", "xxx"), *(Rule(f"trace:{p}", "block", f"(?i){p}", t, 1) for p, t in TRACES))


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    return F.coalesce(F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = SITES + SPAM, default: str = "allow", named: tuple[str, ...] | None = None, with_tried: bool = False) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages (page_id, url); with_tried: also n_tried, how many rules' expressions ran.

    rule: the name of the highest-ranked rule that matches (equal ranks: the first name), verdict: its action; null and
    `default` where none does. named: report only these rules' names, the others just decide. Null url: empty host and
    path, no rule. Null page_ids and repeated rows stay rows of their own; other columns are left. Each distinct pair of
    host and path is judged once, so repeated URLs don't repeat the work.
    """
    if not all(r.tokens for r in rules):
        raise ValueError("a rule without a literal token can't be indexed")
    spark = pages.sparkSession
    sites = pages.select("page_id", "url").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}).drop("url")
    distinct = sites.select("host", "path").distinct()
    text = F.concat("host", "path")
    tokens = F.array_distinct(F.filter(F.split(F.translate(text, _UPPER, _LOWER), "[^0-9a-z]+"), lambda t: t != ""))
    held = distinct.select("host", "path", F.explode(tokens).alias("token"))

    as_json = json.dumps([{"name": r.name, "action": r.action, "pattern": r.pattern, "rank": r.rank, "tokens": r.tokens} for r in rules])
    listed = spark.range(1).select(F.inline(F.from_json(F.lit(as_json), "array<struct<name string, action string, pattern string, rank int, tokens array<string>>>")))
    of_rules = listed.select("name", F.explode("tokens").alias("token"))
    small = len(rules) and sum(len(r.tokens) for r in rules) <= BROADCAST_RULES
    fit = F.broadcast if small else lambda df: df
    common = held.select("token").join(fit(of_rules.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    ranked = of_rules.join(common, "token", "left").groupBy("name").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    index = listed.drop("tokens").join(ranked, "name")

    tried = held.join(fit(index), "token").withColumn("hit", F.expr("regexp_like(concat(host, path), pattern)"))
    best = tried.groupBy("host", "path").agg(F.min_by(F.struct("name", "action"), F.when(F.col("hit"), F.struct(-F.col("rank"), "name"))).alias("best"), F.count("*").alias("n_tried"))
    shown = F.col("best.name") if named is None else F.when(F.col("best.name").isin(*named), F.col("best.name"))
    return sites.join(best, ["host", "path"], "left").select("page_id", "host", "path", shown.alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"), *([F.coalesce("n_tried", F.lit(0)).alias("n_tried")] if with_tried else []))
