"""Loading rule by rule, and the counts that a document of the known shape must give."""

from collections import Counter

import pytest

from sylva.functions.scan import Scanner, clean, decode, nodes
from sylva.functions.schema import LoadOptions
from sylva.plans.callbacks import named_types
from tests.documents import GARDEN, GARDEN_EVENTS


def load(text, options=LoadOptions(), sax=False):
    text, wrong = decode(text) if isinstance(text, bytes) else clean(text)
    s = Scanner(text, options, wrong, sax)
    rows = nodes(s)
    return (None if any(e[2] for e in s.errors) else [(r[5], r[6] or r[8] if r[5] in ("ELEMENT", "TEXT", "OPAQUE", "CDATA", "COMMENT", "DIRECTIVE", "DECLARATION") else r[9] if r[5] == "INTEGER" else r[10] if r[5] == "REAL" else r[12]) for r in rows]), s.errors


def ok(text, options=LoadOptions()):
    rows, errors = load(text, options)
    assert rows is not None, errors
    return rows


def fails(text, options=LoadOptions()):
    rows, errors = load(text, options)
    return rows is None and [m for _, m, _ in errors]


A = ("ELEMENT", "a")


def test_characters():
    assert ok(b"\xfe\xff" + "<a>é</a>".encode("utf-16-be")) == ok(b"\xff\xfe" + "<a>é</a>".encode("utf-16-le")) == [A, ("TEXT", "é")]
    assert ok("<a>x﻿y</a>") == ok("<a>x﻿y</a>".encode()) == [A, ("TEXT", "xy")]
    assert ok("<a>x</a>".encode("utf-16")) == [A, ("TEXT", "x")]
    assert fails(b"<a><b>\xc0\x80</b></a>")[0].startswith("Invalid UTF-8")
    assert fails(b"<a><b>\x80</b></a>") == ["Close tag </b> is missing"]
    assert load(b"<a/>\x80") == ([A], []) and load("<a/>\x01")[0] == [A] and load("<a/>\x01")[1][0][1].startswith("Bad control")
    assert "Bad control character 0x01" in fails("<a><b>\x01</b></a>")
    assert ok("<a>x\ny\rz w</a>") == [A, ("TEXT", "x"), ("TEXT", "y"), ("TEXT", "z w")]


def test_entities():
    assert ok("<a>&lt;&#65;&#x42;&amp;&quot;&apos;&gt;&#32;x</a>") == [A, ("TEXT", "<AB&\"'> x")]
    assert ok("<a>&#65zz;</a>") == [A, ("TEXT", "A")] and fails("<a>&#;</a>") and fails("<a>&#1;</a>") and fails("<a>&#xD800;</a>") and fails("<a>&#1114112;</a>")
    assert fails("<a>&nope;</a>") and fails("<a>&amp x</a>") and fails(f"<a>&{'a' * 64};</a>") and fails("<a>&X41;</a>")
    assert ok("<a>&cur;</a>", LoadOptions(entities={"cur": 8364})) == ok("<a>&cur;</a>", LoadOptions(entities=lambda n: 8364 if n == "cur" else None)) == [A, ("TEXT", "€")]
    assert ok("<a b='&lt;' c=&amp;x><!--&amp;--><![CDATA[&amp;]]><?p &amp;?><!D &amp;></a>", LoadOptions("OPAQUE"))[1:] == [("COMMENT", "&amp;"), ("CDATA", "&amp;"), ("DIRECTIVE", "p &amp;"), ("DECLARATION", "D &")]
    assert ok("<&#97;/>") == [A]


@pytest.mark.parametrize("text", [" <a/>", "x", "<!--c--><a/>", "<a/><b/>", "<a/><!--xx-->", "<a></b>", "<a><b></a>", "<a><b>", "</a>", "<a b/>", "<a b>", "<a b=>", "<a b='1' b='2'/>", "<a href=http://x/>", "<a 'b'='1'/>", "<a <", "<a/x>", "<a+b/>", "<a<b/>", "<a><!--", "<a><![CDATA[x", "<?x", "<!x", "<a b='1", "<!----><a/>", "<a><!--x---></a>"])
def test_failures(text):
    assert load(text)[0] is None


def test_structure():
    assert ok("<?xml?><a/><b/>") == [("DIRECTIVE", "xml"), A, ("ELEMENT", "b")]
    assert ok("<!DOCTYPE x><a></a>") == [("DECLARATION", "DOCTYPE x"), A] and ok("<!DOCTYPE a [<!ENTITY b 'c'>]><a/>", LoadOptions("OPAQUE"))[0] == ("DECLARATION", "DOCTYPE a [<!ENTITY b 'c'")
    assert ok("<a>") == [A] and ok("<a") == [A] and ok("<!--xy-->") == [("COMMENT", "xy")]
    assert ok("<?a?></a>") == [("DIRECTIVE", "a")] and ok("<a></a junk ='>") == [A]
    assert ok("<a><!--a--b--></a>") == [A, ("COMMENT", "a--b")] and ok("<a><!----x--></a>") == [A, ("COMMENT", "--x")]
    assert ok("<a><![CDATA[x]]]></a>") == [A, ("CDATA", "x]")] and ok("<a><?p x>?></a>") == [A, ("DIRECTIVE", "p x>")]
    rows = nodes(Scanner("<a x='1'y=2 z = \"3\"><n:b?></n:b?></a>", LoadOptions()))
    assert rows[0][7] == [("x", "1"), ("y", "2"), ("z", "3")] and rows[1][6] == "n:b?"
    assert [r[:5] for r in nodes(Scanner("<a><b><c/></b><d/></a>", LoadOptions()))] == [[0, None, 3, 0, 0], [1, 0, 2, 1, 0], [2, 1, 2, 2, 0], [3, 0, 3, 1, 1]]
    assert [r[6] for r in nodes(Scanner("<a b='c'?><d/></a>", LoadOptions()))] == ["a", "d"]


def test_values():
    i, r, o = LoadOptions("INTEGER"), LoadOptions("REAL"), LoadOptions("OPAQUE")
    assert ok("<a>1 2\n3</a>", i) == [A, *(("INTEGER", x) for x in (1, 2, 3))]
    assert ok("<a>0x1F 010 -7 99999999999999999999 -99999999999999999999</a>", i)[1:] == [("INTEGER", x) for x in (31, 8, -7, 2**63 - 1, -(2**63))]
    assert ok("<a>1e5 .5 -inf 0x1p3 2.</a>", r)[1:] == [("REAL", x) for x in (1e5, 0.5, float("-inf"), 8.0, 2.0)]
    rows, errors = load("<a>12x</a>", i)
    assert rows == [A, ("INTEGER", 12)] and errors[0][1].startswith("Bad integer") and fails("<?xml?><a>12x</a>", i)
    assert ok("<a>x</a>", i) == [A, ("INTEGER", 0)]
    assert ok("<a> x y <b/> </a>", o) == [A, ("OPAQUE", " x y "), ("ELEMENT", "b"), ("OPAQUE", " ")]
    rows = nodes(Scanner("<a> x y <b/> </a>", LoadOptions()))
    assert [(r[8], r[11]) for r in rows if r[5] == "TEXT"] == [("x", True), ("y", True), ("", True), ("", True)]
    assert nodes(Scanner("<a>x</a>", LoadOptions()))[1][11] is False
    assert fails("<a>x</a>", LoadOptions("CUSTOM")) and fails("<a>x</a>", LoadOptions("CUSTOM", custom_load=lambda s: None)) and fails("<a>x</a>", LoadOptions("ELEMENT"))
    assert ok("<a>x y</a>", LoadOptions("CUSTOM", custom_load=str.upper)) == [A, ("CUSTOM", "X Y")]
    assert ok("<a>x y</a>", LoadOptions("IGNORE")) == [A] and ok("<a>x</a>", None) == [A, ("TEXT", "x")]
    typed = LoadOptions(type_of=lambda n, a: "INTEGER" if n == "i" else "OPAQUE")
    assert ok("<a>x <i>1 2</i> y<i/> 3</a>", typed) == [A, ("OPAQUE", "x "), ("ELEMENT", "i"), ("INTEGER", 1), ("INTEGER", 2), ("OPAQUE", " y"), ("ELEMENT", "i"), ("OPAQUE", " 3")]


def test_known_counts():
    s = Scanner(GARDEN, LoadOptions(type_of=named_types), sax=True)
    assert Counter(e.event for e in s) == GARDEN_EVENTS and not s.errors


def test_fragments():
    """Under a node a text may start with a value and have several roots; a directive holds nothing there, and the last open value is lost."""
    s = Scanner("1 2 <b>x</b><?d?>3 4", LoadOptions(type_of=lambda n, a: "INTEGER" if n == "a" else "TEXT"), top=("a", {}))
    rows = [(r[0], r[1], r[5]) for r in nodes(s, under=True)]
    assert rows == [(0, None, "INTEGER"), (1, None, "INTEGER"), (2, None, "ELEMENT"), (3, 2, "TEXT"), (4, None, "DIRECTIVE"), (5, None, "INTEGER")] and not s.errors
    s = Scanner("<b>", LoadOptions(), top=("a", {}))
    assert list(nodes(s, under=True)) and s.errors[0][1] == "Close tag </b> is missing"


def test_several_roots_for_callbacks():
    assert Counter(e.event for e in Scanner("<a/><b>x</b>", LoadOptions(), sax=True)) == {"ELEMENT_OPEN": 2, "ELEMENT_CLOSE": 2, "DATA": 1}
    assert [e.event for e in Scanner("<a>x y z</a>", LoadOptions("IGNORE"), sax=True)].count("DATA") == 3


def test_mutations_give_rows_or_errors():
    import random

    rng = random.Random(9)
    for _ in range(3000):
        t = list(GARDEN)
        for _ in range(rng.randint(1, 6)):
            i = rng.randrange(len(t))
            t[i : i + rng.randint(0, 3)] = rng.choice(["<", ">", "&", ";", "/", "'", '"', "=", " ", "]]>", "-->", "?>", "\x00", "<!", "x", ""])
        rows, errors = load("".join(t), LoadOptions(type_of=named_types))
        assert rows or errors
