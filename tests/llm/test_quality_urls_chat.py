import re
import unicodedata
from collections import Counter

from sylva.llm.chat import format_chats
from sylva.llm.quality import BASE, MEASUREMENTS, PRODUCTION, RULES, Policy, ablations, judge, ledger, stored
from sylva.llm.urls import OFFERS, SITES, SPAM, TRACES, WARES, Rule, filter_urls, site_rule

WORD = re.compile("[^\x20\x09-\x0d]+")


def measured(text):
    t = text or ""
    w, lines = WORD.findall(t), t.split("\n")
    runs = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(runs)
    again = {i + j for i, r in enumerate(runs) if n[r] > 1 for j in range(5)}
    full = [x for x in lines if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines), len(full) - len(set(full)), len(again)


def more_measured(text):
    t = text or ""
    full = [x for x in t.split("\n") if WORD.search(x)]
    bare = [x.strip(" \t\n\x0b\x0c\r") for x in full]
    letters, upper = (sum(unicodedata.category(c)[: len(k)] == k for c in t) for k in ("L", "Lu"))
    return len(t), letters, upper, max(map(len, WORD.findall(t)), default=0), sum(x[0] in "-*•" for x in bare), sum(x.endswith(("...", "…")) for x in bare), sum(map(len, full)) - sum(map(len, set(full)))


def failures(text):
    n_words, word_chars, symbols, n_lines, dup, again = measured(text)
    chars, letters, upper, longest, bullets, ellipses, dup_chars = more_measured(text)
    failed = [n_words < 10, 5 * again > n_words, 10 * symbols > 3 * word_chars, 2 * dup > n_lines, word_chars < 2 * n_words, word_chars > 20 * n_words, longest > 1000, 2 * letters < word_chars, 2 * upper > letters]
    failed += [10 * bullets > 9 * n_lines, 10 * ellipses > 3 * n_lines, 5 * dup_chars > 2 * chars]
    return sum(1 << i for i, f in enumerate(failed) if f)


def test_ledger(docs, corpus):
    rows = judge(ledger(docs)).collect()
    got = Counter((r["doc_id"], *(r[m] for m in MEASUREMENTS), r["failures"], r["base_failed"]) for r in rows)
    expected = Counter((d, *measured(t), *more_measured(t), failures(t), failures(t) & 3 != 0) for d, t, *_ in corpus)
    assert got == expected and len({r["failures"] for r in rows}) > 4
    assert all(r["kept"] == (r["failures"] == 0) for r in rows) and {r["policy"] for r in rows} == {PRODUCTION.version}
    kept = judge(ledger(docs, "text", "k")).filter("kept")
    assert kept.count() == sum(r["kept"] for r in rows) and kept.columns[:3] == ["doc_id", "text", "k"]


def test_rules_one_by_one(spark):
    """A text that fails each rule, alone where that can be, and one that fails none."""
    say = "some ordinary words that make up a line of text here"
    lines = [f"{say} {i}" for i in range(10)]
    cases = ["few words", "a b c d e " * 4, say + " # $ % & | < > * " * 3, "\n".join([*["xy"] * 9, say]), "a b c d e f g h i j k l m", " ".join(c * 25 for c in "abcdefghijkl"), say + " " + "y" * 1001, "12 34 56 78 90 13 35 57 79 91 14 aa", say.upper(), "\n".join(f"- {x}" for x in lines), "\n".join(f"{x}..." for x in lines), "\n".join([*[say] * 2, *lines[:2]]), say]
    got = {r["doc_id"]: r["failures"] for r in ledger(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")).collect()}
    assert all(got[i] == failures(t) for i, t in enumerate(cases)) and got[12] == 0
    assert all(got[i] >> i & 1 for i in range(11)), got


def test_ablations(docs):
    rows = stored(ledger(docs))
    bits = [r["failures"] for r in rows.collect()]
    for r in ablations(rows, BASE, PRODUCTION, Policy("one", ("symbols",))).collect():
        mask = {p.version: p.mask for p in (BASE, PRODUCTION, Policy("one", ("symbols",)))}[r["version"]]
        bit = 1 << list(RULES).index(r["rule"])
        assert r["rejected"] == sum(b & mask != 0 for b in bits)
        assert r["by_rule"] == sum(b & bit != 0 for b in bits)
        assert r["by_rule_alone"] == sum(b & mask == bit for b in bits)


def test_ledger_empty(nothing):
    assert judge(ledger(nothing)).collect() == []


URLS = [
    "http://a.b.net/x", "https://NET/y?z#q", "http://example.net/en/1", "http://www.example.net/en", "http://example.com/de/x", "http://xexample.com/de/x", "https://fr.org/fr/", "http://a.org/fr/?x", "http://a.org/FR/x",
    "http://net", "http://net?x/", "http://net:80/", "ftp://u@a.net/", "no scheme.net/", "", None, "://net/", "http://", "http://spam-farm.example.org/en/", "http://a.org/cheap_pills.html", "http://a.org/cheapxpills", "http://a.com/xxx", "http://a.com/axxx",
    "http://x.example.net/en/spam-farm", "http://a.com/b://c.net/", "http://a.net/x", "http://a.net/x",
    "http://b.com/best-slots/1", "http://b.com/BEST_Slots", "http://b.com/slots-best", "http://win.lottery.com/", "http://c.com/blog/wp-login.php", "http://c.com/wp-login.phpx", "http://c.com/i/1x1.gif", "http://c.com/i/a1x1.gif", "http://c.com/t/0a1b2c3d4e5f60718293a4b5c6d7e8f9/sid/", "http://c.com/sid/x",
]


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for h, p, v in (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")) if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        _, rule, verdict = max(fits)
    else:
        spam = re.search("(?:^|[^0-9a-z])(?:(?:%s)[^0-9a-z](?:%s)|xxx)(?:[^0-9a-z]|$)" % ("|".join(OFFERS), "|".join(WARES)), (host + path).lower()) or any(re.search(p, host + path, re.I) for p, _ in TRACES)
        rule, verdict = None, "block" if spam else "allow"
    return host, path, rule, verdict


def test_urls(spark, monkeypatch):
    rows = [(i, u, "junk", "t", "n") for i, u in enumerate(URLS)] + [(None, URLS[0], "", "", ""), (3, URLS[3], "", "", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, token string, name string")
    expected = Counter((i, *judged(u)) for i, u, *_ in rows)
    for bound in (100_000, 0):
        monkeypatch.setattr("sylva.llm.urls.BROADCAST_RULES", bound)
        got = filter_urls(pages, named=tuple(r.name for r in SITES))
        assert Counter(map(tuple, got.collect())) == expected
    assert filter_urls(pages.limit(0)).collect() == []


def test_only_candidates_run(spark):
    """A rule whose tokens are all in the URL's must match; one that lacks its rarest token there isn't tried."""
    r = site_rule("block", "example.net/en/")
    assert r.tokens == ("example", "net", "en") and all(x.tokens for x in SPAM)
    odd = Rule("odd", "block", ".*", ("nowhere",), 9999)
    pages = spark.createDataFrame([(1, "http://a.com/"), (2, "http://a.com/best-slots/"), (3, None)], "page_id long, url string")
    assert filter_urls(pages, (odd,)).first()["verdict"] == "allow"
    tried = {r["page_id"]: r["n_tried"] for r in filter_urls(pages, with_tried=True).collect()}
    assert len(SPAM) > 250 and tried[1] == tried[3] == 0 and 0 < tried[2] < 40


def test_chats(spark):
    a, b, c = ("user", "hi"), ("assistant", "hello"), ("user", "bye")
    logged = {1: [a], 2: [a, b], 3: [a, b, c], 4: [a, c], 5: [a, b, c], 6: [b, a], 7: [c], 8: [("user", None)], 9: [(None, "hi")], 10: [("user", "")], None: [a, ("system", "x")]}
    rows = [(conv, i, role, text, 0, "x") for conv, turns in logged.items() for i, (role, text) in enumerate(turns)]
    rows += [rows[0], rows[4], (11, 5, "user", "tie b", 0, ""), (11, 5, "user", "tie a", 0, ""), (12, None, "user", "hi", 0, "")]
    rows += [(None, 7, "user", "alone", 0, ""), (None, 7, "user", "alone", 0, "")]
    kept = format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place int, said string")).collect()
    got = {r["conv_id"]: (r["n_turns"], r["text"]) for r in kept}
    # Rows without conv_id are conversations of one turn each; the one that another conversation starts with goes.
    assert sorted((r["n_turns"], r["text"]) for r in kept if r["conv_id"] is None) == [(1, "<|system|>\nx\n<|end|>\n"), (1, "<|user|>\nalone\n<|end|>\n")]
    assert set(got) == {3, 4, 6, 7, 8, 9, 10, 11, None}
    assert got[3] == (3, "<|user|>\nhi\n<|end|>\n<|assistant|>\nhello\n<|end|>\n<|user|>\nbye\n<|end|>\n")
    assert got[11][1].index("tie a") < got[11][1].index("tie b") and got[9][1] == "<|user|>\nhi\n<|end|>\n"
    assert format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
