"""Plain documents cut by array operations give what the scanner gives, or are left to it."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql.pandas.types import to_arrow_schema

from sylva.functions import columns
from sylva.functions.schema import NODE, LoadOptions, Watch
from sylva.plans.callbacks import order_types
from sylva.sources import xml
from tests.test_plain import OPTIONS, PARTS, by_scanner

KINDS = {f.name: f.type for f in to_arrow_schema(NODE)}
MORE = ["0", "007", "123456789012345", "1234567890123456", "é ü", "\t\n", "'", '"', '<e a="1" b="2" c="\'>"/>', '<f a="é ü"/>', "<g  a=\"1\"/>", "</a b=\"1\">", "<h/>", "<i a=\"1\"b=\"2\"/>", "<?x?>", "<j a=\"\"/>", "<k a = \"1\"/>", "﻿"]


def by_columns(texts, options, kinds=KINDS):
    plain, doc, made = columns.plain_columns(pa.array(texts, pa.string()), options, kinds)
    rows = [[] if p else None for p in plain]
    held = [made[c].to_pylist() if c in made else [None] * len(doc) for c in NODE.fieldNames()[1:]]
    for d, *row in zip(doc.tolist(), *held):
        row[7] = row[7] and [(a["name"], a["value"]) for a in row[7]]
        rows[d].append(["d", *row])
    return rows


@pytest.mark.parametrize("options", OPTIONS)
def test_same_as_the_scanner(options):
    rng, quick = random.Random(11), 0
    for _ in range(60):
        texts = [None, "", "<a>", "x", "<?x?>", "<?xml?><a/>"]
        for _ in range(100):
            inner, open_ = [], []
            for _ in range(rng.randrange(9)):
                p = rng.choice(PARTS + MORE if rng.random() < 0.3 else ["<a>", "<qty>", '<b x="1" y="2">', "12", "7 x ", " ", "two words", '<a k="v"/>', "é"])
                inner.append(p)
                if p[0] == "<" and p[1] not in "!?/" and p[-2] != "/":
                    open_.append(p.strip("<>").split()[0])
                if open_ and rng.random() < 0.5:
                    inner.append(f"</{open_.pop()}>")
            body = "".join(inner) + "".join(f"</{x}>" for x in reversed(open_) if rng.random() < 0.95)
            texts += [f'<?xml version="1.0"?><a>{body}</a>', f"<a>{body}</a>", body, f"<?x?><?y?>{body}"]
        # Batches of one document, too, as what a batch lacks altogether is a case of its own.
        for text, made in [*zip(texts, by_columns(texts, options)), *((t, by_columns([t], options)[0]) for t in [*texts[:30], "<a/>", '<a b="1"/>', "<?x?><a/>", "<a></a>", "<a>7</a>", "<a> </a>"])]:
            if made is not None:
                quick += 1
                want = by_scanner(text, options, None)
                assert [[*r[:8], r[8] if r[8] is None else list(r[8]), *r[9:]] for r in want] == [[*r[:8], r[8] or ([] if r[6] == "ELEMENT" else None), *r[9:]] for r in made], text
    assert quick > 300 or options.value_type == "CUSTOM"


def test_orders_need_no_scanner_and_a_batch_is_cut_in_parts(monkeypatch):
    texts = [f'<?xml version="1.0"?><order id="{i}" status="O"><item line="1" part="2" flag="N"><qty>{i}</qty><price>400</price></item></order>' for i in range(50)]
    assert list(map(len, by_columns(texts, LoadOptions(type_of=order_types)))) == [7] * 50
    monkeypatch.setattr(columns, "SLICE", 300)
    batch = pa.record_batch([pa.array(range(50)), pa.array(texts)], names=["a", "b"]).slice(3)
    parts = list(columns.slices(batch, 1))
    assert len(parts) > 10 and sum(p.num_rows for p in parts) == 47
    assert [made for p in parts for made in by_columns(p.column(1), LoadOptions(type_of=order_types))] == by_columns(texts[3:], LoadOptions(type_of=order_types))


@pytest.mark.parametrize("options", OPTIONS)
def test_kept_events_are_those_of_the_scanner(options, monkeypatch):
    rng, by_row, quick = random.Random(5), [], 0
    texts = [f'<?xml version="1.0"?><a k="v">{"".join(rng.choice(["<b/>", "<qty>7</qty>", "<qty></qty>", "<c x=\'1\'>two words </c>", "<c x=\"1\" y=\"\">3</c>", "<a><b k=\"v\"><qty>1</qty></b></a>", "&amp;", "<!--x-->"]) for _ in range(rng.randrange(6)))}</a>' for _ in range(300)]
    some = lambda seen: seen.parent_kept or len(seen.attrs) == 1 or seen.value == 7 or len(seen.parents) == 2 and seen.event == "ELEMENT_CLOSE"
    batch = pa.record_batch([pa.array([f"d{i}" for i in range(len(texts))]), pa.array(texts)], names=["doc_id", "value"])
    for keep in (None, some):
        want = [row for i, text in enumerate(texts) for row in xml.kept_rows(Watch(keep=keep))(f"d{i}", text, options)]
        monkeypatch.setattr(xml, "_by_row", lambda make, *_: lambda batches: ((by_row.append(d), pa.RecordBatch.from_pylist([{"r": repr((*r[:7], r[7] or None, *r[8:]))} for r in make(d, t, options)]))[1] for b in batches for d, t in zip(b[0].to_pylist(), b[1].to_pylist())))
        monkeypatch.setattr(xml, "_batch", lambda schema: lambda rows: pa.RecordBatch.from_pylist([{"r": repr((*r[:7], r[7] or None, *r[8:]))} for r in rows]))
        made = [r for b in xml._kept_by_slice(Watch(keep=keep), None, options)([batch]) for r in (b["r"].to_pylist() if b.num_columns else [])]
        assert sorted(made) == sorted(repr((*r[:7], r[7] or None, *r[8:])) for r in want)
        quick += len(texts) - len(set(by_row))
    assert quick > 0 or options.value_type in ("CUSTOM", "IGNORE")
