"""The registered queries of this subpackage: each operator with production parameters on its whole table, and SQL where SQL can express it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.llm.bpe import encode_decode
from sylva.llm.chat import format_chats
from sylva.llm.collocations import collocations
from sylva.llm.decontamination import decontaminate, near_items
from sylva.llm.lines import LineDedup
from sylva.llm.media import text_media
from sylva.llm.near import near_duplicates
from sylva.llm.packing import pack
from sylva.llm.periods import find_runs, planted
from sylva.llm.quality import BASE, PRODUCTION, RULES, ablations, judge, ledger, stored
from sylva.llm.scoring import score
from sylva.llm.shared import table
from sylva.llm.substrings import remove_repeats
from sylva.llm.urls import OFFERS, SITES, TRACES, WARES, filter_urls

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """The tokenizer's file: under $TOKENIZERS_DIR if set, else of the installed public tokenizers."""
    if folder := os.environ.get("TOKENIZERS_DIR"):
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, lines = table(spark, sf_dir, "documents"), LineDedup(spark, min_docs=10, min_chars=1)
    return lines.apply(lines.insert(lines.empty(), docs), docs)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), room=4096, end=1)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), length=13)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judge(stored(ledger(table(spark, sf_dir, "documents"))))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failures")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the policies rejects, in all and alone, from the stored ledger."""
    return ablations(stored(ledger(table(spark, sf_dir, "documents"))), BASE, PRODUCTION)


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), named=tuple(r.name for r in SITES))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), order=3)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(table(spark, sf_dir, "documents"), with_digest=True)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_runs(table(spark, sf_dir, "documents"), planted)


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def proximity_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with items of which ten consecutive words stand there, each at most two words from its place."""
    return near_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    own = [op1_line_dedup, op2_bpe, op3_packing, op4_near_dedup, op5_chat, op6_substring_dedup, op7_quality, op8_urls, op9_lm_scores, op10_media, op11_collocations, op12_periods, op13_decontamination, quality_ablations, proximity_matches, pipeline]
    return {f.__name__: f for f in own}


# --- SQL ----------------------------------------------------------------------------------------------------

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_LETTERS = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_WORDS = "regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+')"


def oracle_sql() -> dict[str, str]:
    lines = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents
), keyed AS (SELECT *, translate(trim(line, {_WS}), {_LOWER}) AS key FROM lines),
often AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(often.key)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE often.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN often USING (key) GROUP BY doc_id"""

    near = f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^ \\t-\\r]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
either AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, either.b FROM reach JOIN either ON either.a = reach.r)
SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(r) AS component_id, min(r) = d.doc_id AS kept
FROM documents d JOIN reach ON reach.doc_id = d.doc_id LEFT JOIN sizes ON sizes.doc_id = d.doc_id GROUP BY d.doc_id"""

    chat = """
WITH turns AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)),
prefixes AS (SELECT conv_id, place, list({'role': role, 'text': text}) OVER (PARTITION BY conv_id ORDER BY place) AS said, count(*) OVER (PARTITION BY conv_id) AS n FROM turns),
wholes AS (SELECT min(conv_id) AS conv_id, said, n FROM prefixes WHERE place = n GROUP BY said, n),
maximal AS (SELECT conv_id, n FROM wholes WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.place < p.n AND p.place = wholes.n AND p.said = wholes.said))
SELECT conv_id, n::BIGINT AS n_turns, string_agg('<|' || coalesce(role, 'user') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10), '' ORDER BY place) AS text
FROM maximal JOIN turns USING (conv_id) GROUP BY conv_id, n"""

    repeats = f"""
WITH words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13)),
hits AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY s) AS first FROM windows) WHERE doc_id > first),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(13)) AS i FROM hits),
each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words)
SELECT d.doc_id, count(each.i)::BIGINT AS n_words, count(gone.i)::BIGINT AS n_removed,
  sha256(coalesce(string_agg(word, ' ' ORDER BY each.i) FILTER (WHERE gone.i IS NULL AND word IS NOT NULL), '')) AS kept_sha256
FROM documents d LEFT JOIN each ON each.doc_id = d.doc_id LEFT JOIN gone ON gone.doc_id = each.doc_id AND gone.i = each.i GROUP BY d.doc_id"""

    ledger_sql = f"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM base WHERE len(w) >= 5)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, i + unnest(range(5)) AS i FROM again) GROUP BY doc_id),
lined AS (SELECT doc_id, len(l) AS n_lines, list_filter(l, lambda x: regexp_matches(x, '[^ \\t-\\r]')) AS filled FROM base),
bare AS (SELECT doc_id, list_transform(filled, lambda x: trim(x, {_WS})) AS b FROM lined),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, n_lines, (len(filled) - len(list_distinct(filled)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
  length(t) - length(regexp_replace(t, '\\p{{L}}+', '', 'g')) AS n_letters, length(t) - length(regexp_replace(t, '\\p{{Lu}}+', '', 'g')) AS n_upper, coalesce(list_max(list_transform(w, lambda x: length(x))), 0) AS longest_word,
  len(list_filter(b, lambda x: x[1] IN ('-', '*', '•'))) AS n_bullet_lines, len(list_filter(b, lambda x: ends_with(x, '...') OR ends_with(x, '…'))) AS n_ellipsis_lines, length(t) AS text_chars,
  length(array_to_string(filled, '')) - length(array_to_string(list_distinct(filled), '')) AS dup_line_chars
  FROM base JOIN lined USING (doc_id) JOIN bare USING (doc_id) LEFT JOIN covered USING (doc_id)),
f AS (SELECT *, ({" + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, rule in enumerate(RULES.values()))})::BIGINT AS failures FROM m)"""
    quality = ledger_sql + " SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & 3 != 0 AS base_failed, failures = 0 AS kept, failures FROM f"
    cases = ", ".join(f"('{p.version}', '{r}', {p.mask}, {1 << list(RULES).index(r)})" for p in (BASE, PRODUCTION) for r in p.rules)
    ablated = ledger_sql + f""" SELECT version, rule, count(*) FILTER (WHERE failures & mask != 0) AS rejected, count(*) FILTER (WHERE failures & bit != 0) AS by_rule, count(*) FILTER (WHERE failures & mask = bit) AS by_rule_alone
FROM f, (VALUES {cases}) p(version, rule, mask, bit) GROUP BY 1, 2"""

    spam = "|".join([f"(^|[^0-9a-z])(({'|'.join(OFFERS)})[^0-9a-z]({'|'.join(WARES)})|xxx)([^0-9a-z]|$)", *(p for p, _ in TRACES)])
    urls = f"""
WITH parts AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
sites AS (SELECT page_id, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), {_LOWER}) AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM parts),
rules (rule, verdict, h, p) AS (VALUES ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'), ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')),
found AS (SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM sites LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN regexp_matches(host || path, '(?i){spam}') THEN 'block' ELSE 'allow' END) AS verdict FROM found"""

    scores = f"""
WITH words AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
grams AS (SELECT *, lag(w) OVER d AS p, lag(w, 2) OVER d AS q FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
others AS (SELECT doc_id, i, p, q, count(*) OVER () - count(*) OVER (PARTITION BY doc_id) AS r0, count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY doc_id, w) AS r1,
  count(*) OVER (PARTITION BY p, w) - count(*) OVER (PARTITION BY doc_id, p, w) AS r2, count(*) OVER (PARTITION BY q, p, w) - count(*) OVER (PARTITION BY doc_id, q, p, w) AS r3 FROM grams),
places AS (SELECT *, (p IS NOT NULL)::INTEGER + (q IS NOT NULL)::INTEGER AS more, lag(r1) OVER d AS x1, lag(r2) OVER d AS x2 FROM others WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
scored AS (SELECT doc_id, count(*) AS n, sum(round(1000000 * CASE WHEN q IS NOT NULL AND r3 > 0 THEN ln(r3 / x2) WHEN p IS NOT NULL AND r2 > 0 THEN ln(r2 / x1) + (more - 1) * ln(0.4::DOUBLE)
  WHEN r1 > 0 THEN ln(r1 / r0) + more * ln(0.4::DOUBLE) ELSE ln(1 / greatest(r0, 1)) + (more + 1) * ln(0.4::DOUBLE) END)::BIGINT)::BIGINT AS s FROM places GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(s, 0)::BIGINT AS score_micro, s / n / 1000000 AS mean_score FROM documents d LEFT JOIN scored USING (doc_id)"""

    mined = f"""
WITH docs AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), {_LOWER}) AS t FROM documents),
pieces AS (SELECT row_number() OVER () AS p, lang, regexp_extract_all(piece, '[^ \\t]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\n\\x0B\\x0C\\r]')) AS piece FROM docs)),
totals AS (SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang),
grams AS (SELECT lang, m, w[i:i+m-1] AS g, count(*) AS f FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM pieces, range(1, 6) r(m)) GROUP BY ALL HAVING count(*) >= 100),
inner_grams AS (SELECT DISTINCT lang, g[i:i+k-1] AS g, f FROM (SELECT lang, g, f, k, unnest(range(1, m - k + 2)) AS i FROM grams, range(2, 5) r(k) WHERE k < m)),
free AS (SELECT * FROM grams a WHERE m > 1 AND NOT EXISTS (SELECT 1 FROM inner_grams b WHERE b.lang = a.lang AND b.g = a.g AND b.f >= a.f)),
cuts AS (SELECT lang, free.g, free.f AS a, x.f AS l, y.f AS r, n, k, (1000::HUGEINT * free.f * n) // (x.f::HUGEINT * y.f) AS score
  FROM (SELECT lang, g, f, unnest(range(1, m)) AS k FROM free) free JOIN grams x USING (lang) JOIN grams y USING (lang) JOIN totals USING (lang) WHERE x.g = free.g[1:k] AND y.g = free.g[k+1:]),
least AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank, array_to_string(g, ' ') AS phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM least QUALIFY rank <= 2000"""

    passages = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '{_LETTERS}') AS w FROM documents),
windows AS (SELECT DISTINCT item_id::VARCHAR AS item, array_to_string(w[i:i+9], ' ') AS s, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '{_LETTERS}') AS w FROM benchmark) WHERE len(w) > 0)),
grams AS (SELECT r, n, i, array_to_string(w[i:i+n-1], ' ') AS s FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows))),
"""
    exact = passages + """found AS (SELECT r, i, grams.n, item FROM grams JOIN windows USING (n, s)),
hit AS (SELECT r, count(DISTINCT i) AS n FROM (SELECT r, i + unnest(range(n)) AS i FROM (SELECT DISTINCT r, i, n FROM found)) GROUP BY r),
held AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM found WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(held.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, hit.n IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN held USING (r)"""

    near_sql = passages + """posts AS (SELECT r, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM d),
df AS (SELECT t, count(*) AS df FROM posts GROUP BY t),
words AS (SELECT s, n, unnest(string_split(s, ' ')) AS t, generate_subscripts(string_split(s, ' '), 1) AS o FROM (SELECT DISTINCT s, n FROM windows)),
ranked AS (SELECT s, n, t, o, row_number() OVER (PARTITION BY s ORDER BY df, t, o) AS place FROM words JOIN df USING (t)),
begun AS (SELECT s, n, r, p, ranked.o FROM ranked JOIN posts USING (t) WHERE place = 1),
pairs AS (SELECT begun.s, begun.n, r, begun.p - begun.o AS z FROM begun WHERE n = 1 OR EXISTS (SELECT 1 FROM ranked x JOIN posts q ON q.t = x.t WHERE x.place = 2 AND x.s = begun.s AND q.r = begun.r AND abs(q.p - (begun.p - begun.o + x.o)) <= 2)),
each AS (SELECT pairs.s, pairs.n, pairs.r, z, x.place, min(abs(q.p - (z + x.o))) AS off_by FROM pairs JOIN ranked x ON x.s = pairs.s JOIN posts q ON q.r = pairs.r AND q.t = x.t AND abs(q.p - (z + x.o)) <= CASE place WHEN 1 THEN 0 ELSE 2 END GROUP BY ALL),
whole AS (SELECT s, r, z, sum(off_by) AS off_by FROM each GROUP BY s, n, r, z HAVING count(*) = any_value(n))
SELECT doc_id, item AS item_id, count(*) AS n_places, min(off_by)::BIGINT AS off_by FROM whole JOIN windows USING (s) JOIN d USING (r) WHERE item IS NOT NULL GROUP BY r, doc_id, item"""

    return {"op1_line_dedup": lines, "op4_near_dedup": near, "op5_chat": chat, "op6_substring_dedup": repeats, "op7_quality": quality, "quality_ablations": ablated, "op8_urls": urls, "op9_lm_scores": scores, "op11_collocations": mined, "op13_decontamination": exact, "proximity_matches": near_sql}
