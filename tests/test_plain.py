"""The quick way of loading plain documents gives what the scanner gives, or leaves the document to it."""

from __future__ import annotations

import random

import pytest

from sylva.functions.scan import Scanner, clean, nodes, plain_rows
from sylva.functions.schema import LoadOptions
from sylva.plans.callbacks import lower, named_types, order_types

OPTIONS = [LoadOptions(), LoadOptions(None), LoadOptions("OPAQUE"), LoadOptions("IGNORE"), LoadOptions("INTEGER"), LoadOptions(type_of=order_types), LoadOptions(type_of=named_types, custom_load=lower), LoadOptions("CUSTOM")]
PARTS = ['<a>', '</a>', '<qty>', '</qty>', '<b x="1" y="2">', '</b>', '<b x="1" x="2">', '<integer>', '</integer>', '<custom>', '</custom>', '<opaque/>', '<a k="v"/>', ' ', '\n', '12', '-7', '1.5', 'two words', ' x ', '&amp;', '&no;', '<!--xx-->', '<![CDATA[y]]>', '<?z?>', '</a >', "<c d='1'>", '<real>', '</real>']


def by_scanner(text, options, top):
    s = Scanner(text, options, None, False, top)
    rows = nodes(s, under=top is not None)
    return None if any(fatal for _, _, fatal in s.errors) else [["d", *row, None] for row in rows]


@pytest.mark.parametrize("options", OPTIONS)
def test_same_as_the_scanner(options):
    rng, quick = random.Random(7), 0
    for _ in range(6000):
        inner, open_ = [], []
        for _ in range(rng.randrange(9)):
            p = rng.choice(PARTS)
            inner.append(p)
            if p[0] == "<" and p[1] not in "!?/" and p[-2] != "/":
                open_.append(p.strip("<>").split()[0])
            if open_ and rng.random() < 0.5:
                inner.append(f"</{open_.pop()}>")
        body = "".join(inner) + "".join(f"</{x}>" for x in reversed(open_) if rng.random() < 0.95)
        for text, top in ((f'<?xml version="1.0"?><a>{body}</a>', None), (f"<a>{body}</a>", None), (body, None), (body, ("integer", {})), (body, ("b", {"type": "opaque"})), (f"{body}<a/>", ("a", {}))):
            text, _ = clean(text)
            made = plain_rows("d", text, options, top)
            if made is not None:
                quick += 1
                assert made == by_scanner(text, options, top), (text, top)
    assert quick > 1000


def test_orders_are_loaded_quickly():
    text = '<?xml version="1.0"?><order id="1" status="O"><item line="1" part="2" flag="N"><qty>3</qty><price>400</price></item></order>'
    assert len(plain_rows("d", text, LoadOptions(type_of=order_types))) == 7
