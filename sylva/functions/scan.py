"""One document's characters to events: the small per-row helper behind loading.

A document is lenient markup: no namespaces, no document types, quotes optional. Regular expressions take whole runs
of characters at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

from sylva.functions.schema import LoadOptions

SPACE = " \t\r\n"
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")
_ENTITY = re.compile("&([A-Za-z0-9#]*)(;?)")
_TAG_NAME = re.compile("[^ \t\r\n></]*")
_ATTR_NAME = re.compile("[^ \t\r\n=/>?]*")
_BARE_VALUE = re.compile("[^ \t\r\n=/>]*")
_ODD_NAME = re.compile("[\"#$%'()*+,]")  # characters below '0' but for ! - . / &
_PLAIN_ATTR = re.compile("[ \t\r\n]*([^ \t\r\n=/>?<\"'&]+)=(?:\"([^\"&]*)\"|'([^'&]*)')")
_PLAIN_TAG = re.compile("<(/?)([A-Za-z_][A-Za-z0-9_.:-]*)>")
_SPLIT = re.compile("[ \t\r\n]+")
_BLANKS = re.compile("[ \t\r\n]*")
_COMMENT = re.compile(".*?[^-](?=-->)", re.DOTALL)
_INTEGER = re.compile(r"\s*([+-]?)(0[xX][0-9a-fA-F]+|0[0-7]*|[1-9][0-9]*)")
_REAL = re.compile(r"\s*[+-]?(?:0x(?:[0-9a-f]+\.?[0-9a-f]*|\.[0-9a-f]+)(?:p[+-]?\d+)?|(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?|inf(?:inity)?|nan)", re.IGNORECASE)
#: The built-in entities.
ENTITIES = {"amp": 38, "apos": 39, "gt": 62, "lt": 60, "quot": 34}
LONG = 1 << 63


class Event(NamedTuple):
    event: str
    node_type: str | None = None
    name: str | None = None
    attrs: list[tuple[str, str]] | None = None
    str_value: str | None = None
    int_value: int | None = None
    real_value: float | None = None
    ws: bool | None = None
    custom: str | None = None


class Failure(Exception):
    """A document can't be loaded. message may be empty: some failures have none."""

    def __init__(self, message: str, at: int = 0):
        self.message, self.at = message, at


def decode(data: bytes) -> tuple[str, str | None]:
    """The characters up to the end or the first broken one, and what is wrong with that ('' if it counts as the end).

    UTF-8, until the two bytes of a UTF-16 byte order mark, from which on it is UTF-16 of that order.
    """
    try:
        return clean(data.decode("utf-8"))
    except UnicodeDecodeError as e:
        text, rest = data[: e.start].decode("utf-8"), data[e.start :]
    order = {b"\xfe\xff": "utf-16-be", b"\xff\xfe": "utf-16-le"}.get(rest[:2])
    if order:
        wide = rest[2:].decode(order, "surrogatepass")
        bad = re.search("[\ud800-\udfff]", wide)
        last = next((i for i, c in enumerate(wide) if ord(c) > 0xFFFF and ord(c) & 0x3FF == 0x3FF), None)  # a low half of DFFF ends the text
        cut = min([len(wide), *([bad.start()] if bad else []), *([last] if last is not None else [])])
        head, wrong = clean(text)
        if wrong is not None:
            return head, wrong
        tail, wrong = clean(wide[:cut], marks=False)
        return head + tail, wrong if wrong is not None or cut == len(wide) else ""
    head, wrong = clean(text)
    if wrong is not None:
        return head, wrong
    long = rest[:1] in (b"\xc0", b"\xc1") or rest[:1] == b"\xe0" and rest[1:2] < b"\xa0" or rest[:1] == b"\xf0" and rest[1:2] < b"\x90"
    return head, "Invalid UTF-8 sequence" if long and len(rest) > 1 else ""


def clean(text: str, marks: bool = True) -> tuple[str, str | None]:
    """A string up to its first control character, without byte order marks."""
    bad = _CONTROL.search(text)
    if bad:
        text = text[: bad.start()]
    return text.replace("﻿", "") if marks else text, f"Bad control character 0x{ord(bad[0]):02x}" if bad else None


def unescape(text: str, options: LoadOptions, at: int = 0) -> str:
    def one(m: re.Match) -> str:
        name, end = m[1], m[2]
        if len(name) > 63:
            raise Failure("Entity name too long", at + m.start())
        if not end:
            raise Failure(f"Entity &{name} is not terminated", at + m.start())
        if name[:1] == "#":
            digits = re.match("[0-9a-fA-F]*" if name[1:2] == "x" else "[0-9]*", name[2 if name[1:2] == "x" else 1 :])[0]
            code: int | None = int(digits or "0", 16 if name[1:2] == "x" else 10)
        elif name in ENTITIES:
            code = ENTITIES[name]
        else:
            code = options.entities(name) if callable(options.entities) else options.entities.get(name)
        if code is None or code < 0:
            raise Failure(f"Entity &{name}; is not known", at + m.start())
        if code < 32 and code not in (9, 10, 13):
            raise Failure(f"Bad control character 0x{code:02x} in an entity", at + m.start())
        if code > 0x10FFFF or 0xD800 <= code < 0xE000:
            raise Failure(f"Entity &{name}; is no character", at + m.start())
        return chr(code)

    return _ENTITY.sub(one, text) if "&" in text else text


def integer(text: str) -> tuple[int, bool]:
    """The number at the start, clamped to 64 bits, and whether that was all; 0x starts base 16, 0 base 8."""
    m = _INTEGER.match(text)
    if not m:
        return 0, not text
    base = 16 if m[2][:2] in ("0x", "0X") else 8 if m[2][0] == "0" else 10
    return max(-LONG, min(LONG - 1, int(m[1] + m[2], base))), m.end() == len(text)


def real(text: str) -> tuple[float, bool]:
    m = _REAL.match(text)
    if not m:
        return 0.0, not text
    return float.fromhex(m[0]) if "0x" in m[0].lower() else float(m[0]), m.end() == len(text)


class Scanner:
    """Iterating gives a document's events; `errors` then has (line, message, fatal). Nodes of a fatally failed load don't count.

    sax: as if every node were given up after its event, so a second root may follow the first. top: names of the open
    elements that the text is a fragment of (it may then start with a value). `at` is where the value or tag begins that is being
    scanned, or a value before that tag.
    """

    def __init__(self, text: str, options: LoadOptions | None, wrong: str | None = None, sax: bool = False, top: tuple[str, dict] | None = None):
        self.text, self.options, self.sax, self.top = text, options or LoadOptions(None), sax, top
        self.at = 0
        self.errors: list[tuple[int, str, bool]] = [(text.count("\n") + 1, wrong, False)] if wrong else []

    def __iter__(self) -> Iterator[Event]:
        try:
            yield from self._events()
        except Failure as e:
            self.errors.append((self.text.count("\n", 0, e.at) + 1, e.message, True))

    def _type(self, parent: tuple[str, dict] | None, before: str, default: str) -> str:
        o = self.options
        if o.type_of:
            return o.type_of(parent[0], parent[1]) if parent else before
        return o.value_type or default

    def _value(self, kind: str, token: str, ws: bool, parent: str, at: int) -> tuple[Event, str | None]:
        if kind == "TEXT":
            return Event("DATA", kind, str_value=token, ws=ws), None
        if kind == "OPAQUE":
            return Event("DATA", kind, str_value=token), None
        if kind == "IGNORE":
            return Event("DATA"), None
        if kind in ("INTEGER", "REAL"):
            value, whole = (integer if kind == "INTEGER" else real)(token)
            made = Event("DATA", kind, int_value=value) if kind == "INTEGER" else Event("DATA", kind, real_value=value)
            return made, None if whole else f"Bad {kind.lower()} value '{token}' in <{parent}>"
        loaded = self.options.custom_load(token) if kind == "CUSTOM" and self.options.custom_load else None
        if loaded is None:
            raise Failure(f"A value of type {kind} can't be added to <{parent}>", at)
        return Event("DATA", kind, custom=loaded), None

    def _attributes(self, at: int, element: str) -> tuple[list[tuple[str, str]], str, int]:
        """Attributes from `at` on, the character that ended the tag, and the place after it."""
        text, attrs = self.text, []
        while m := _PLAIN_ATTR.match(text, at):
            if any(a[0] == m[1] for a in attrs):
                break
            attrs.append((m[1], m[2] if m[2] is not None else m[3]))
            at = m.end()
        while (at := _BLANKS.match(text, at).end()) < len(text):
            c = text[at]
            if c in "/?":
                if text[at + 1 : at + 2] != ">":
                    raise Failure(f"'>' expected after '{c}' in <{element}>", at)
                return attrs, c, at + 2
            if c == "<":
                raise Failure(f"Bare < in <{element}>", at)
            if c == ">":
                return attrs, c, at + 1
            if c in "\"'":
                raise Failure(f"An attribute of <{element}> has no value", at)
            end = _ATTR_NAME.match(text, at + 1).end()
            name = c + unescape(text[at + 1 : end], self.options, at)
            if any(a[0] == name for a in attrs):
                raise Failure(f"Attribute '{name}' of <{element}> is given twice", at)
            at = _BLANKS.match(text, end).end()
            if text[at : at + 1] != "=" or (at := _BLANKS.match(text, at + 1).end()) >= len(text):
                raise Failure(f"Attribute '{name}' of <{element}> has no value", at)
            quote = text[at]
            if quote in "\"'":
                end = text.find(quote, at + 1)
                if end < 0:
                    raise Failure("", len(text))
                attrs.append((name, unescape(text[at + 1 : end], self.options, at)))
                at = end + 1
            else:
                end = _BARE_VALUE.match(text, at + 1).end()
                attrs.append((name, quote + unescape(text[at + 1 : end], self.options, at)))
                if text[end : end + 1] == "/" and text[end + 1 : end + 2] != ">":
                    raise Failure(f"'>' expected after '/' in <{element}>", end)
                at = end + (text[end : end + 1] not in ("/", ">"))
        raise Failure("", len(text))

    def _events(self) -> Iterator[Event]:
        text, options, sax = self.text, self.options, self.sax
        stack: list[tuple[str, dict]] = [self.top] if self.top else []  # open elements, and a directive or declaration that holds all
        base, rooted = len(stack), False
        kind = self._type(self.top, "IGNORE", "IGNORE")
        kinds = [kind] * base  # the value types in what is open
        if text and text[0] != "<" and not self.top:
            raise Failure(f"The text doesn't start with '<' but with '{text[0]}'")
        at = 0
        while at < len(text):
            self.at = at
            end = text.find("<", at)
            if end != at:
                # Values up to the next tag; at the end of the text a last one that nothing follows is lost.
                run, last = (text[at:end], False) if end >= 0 else (text[at:], True)
                parent = stack[-1][0] if stack else "null"
                if kind in ("OPAQUE", "CUSTOM"):
                    tokens, trailing = [(run, False)] if not last else [], False
                elif not last and not _SPLIT.search(run):
                    tokens, trailing = [(run, False)], False
                else:
                    parts = _SPLIT.split(run)
                    trailing = not parts[-1]
                    tokens = [(p, i > 0) for i, p in enumerate(parts) if p]
                    tokens = tokens[:-1] if last and tokens and not trailing else tokens
                if last and "&" in run:
                    unescape(run, options, at)
                for token, ws in tokens:
                    event, wrong = self._value(kind, unescape(token, options, at) if "&" in token else token, ws, parent, at)
                    if stack or sax:
                        yield event
                    if wrong:
                        self.errors.append((text.count("\n", 0, at) + 1, wrong, False))
                        self._close(stack, base, at)
                        return
                if trailing and not last and kind == "TEXT" and stack:
                    yield Event("DATA", "TEXT", str_value="", ws=True)
                if last:
                    break
            # Tags without attributes, and those that close what is open.
            m = _PLAIN_TAG.match(text, end) if stack else None
            if m:
                shut, name = m.groups()
                if not shut:
                    at = m.end()
                    yield Event("ELEMENT_OPEN", "ELEMENT", name, [])
                    stack.append((name, {}))
                    kind = self._type(stack[-1], kind, "TEXT")
                    kinds.append(kind)
                    continue
                if name == stack[-1][0]:
                    at = m.end()
                    stack.pop(), kinds.pop()
                    yield Event("ELEMENT_CLOSE", "ELEMENT", name)
                    rooted &= not (sax and not stack)
                    kind = kinds[-1] if options.type_of and kinds else kind
                    continue
            at, rootless = end + 1, not stack and rooted

            if text.startswith(("?", "!--", "![CDATA["), at):
                what, start, stop = ("DIRECTIVE", 1, "?>") if text[at] == "?" else ("COMMENT", 3, "-->") if text[at + 1] == "-" else ("CDATA", 8, "]]>")
                if what == "COMMENT":
                    m = _COMMENT.match(text, at + start)
                    close = m.end() if m else -1
                else:
                    close = text.find(stop, at if what == "DIRECTIVE" else at + start)
                if close < 0:
                    raise Failure(f"The text ends in a {what.lower()}", len(text))
                if rootless:
                    raise Failure(f"A {what.lower()} can't be a second root", at)
                value = text[at + start : max(at + start, close)]
                at = close + len(stop)
                yield Event(what, what, str_value=value)
                stays = not sax or what == "DIRECTIVE" and value.startswith("xml ")
                rooted |= stays
                if what == "DIRECTIVE" and not stack and stays:
                    stack.append((value, {}))
                    kind = self._type(stack[-1], kind, "TEXT")
                    kinds.append(kind)
                continue

            end = _TAG_NAME.match(text, at + (text[at : at + 1] == "/")).end()
            name = text[at:end]
            if "<" in text[at : end + 1]:
                raise Failure("Bare < in a tag", at)
            if _ODD_NAME.search(_ENTITY.sub("", name) if "&" in name else name):
                raise Failure("", at)
            if name[:1] == "!":
                close = text.find(">", at)
                if close < 0:
                    raise Failure("The text ends in a declaration", len(text))
                if rootless:
                    raise Failure("A declaration can't be a second root", at)
                value = unescape(text[at + 1 : close], options, at)
                at = close + 1
                yield Event("DECLARATION", "DECLARATION", str_value=value)
                if not sax:
                    rooted = True
                    if not stack:
                        stack.append((value, {}))
                        kind = self._type(stack[-1], kind, "TEXT")
                        kinds.append(kind)
                continue

            name = unescape(name, options, at)
            if name[:1] == "/":
                if not stack or name[1:] != stack[-1][0]:
                    raise Failure(f"Close tag <{name}> doesn't match <{stack[-1][0] if stack else 'null'}>", at)
                close = text.find(">", end)
                at = close + 1 if close >= 0 else len(text)
                gone, _ = stack.pop(), kinds.pop()
                yield Event("ELEMENT_CLOSE", "ELEMENT", gone[0])
                rooted &= not (sax and not stack)
                kind = kinds[-1] if options.type_of and kinds else kind
                continue

            if rootless:
                raise Failure(f"<{name}> can't be a second root", at)
            attrs, by, at = [], text[end : end + 1], end + 1
            if by and by in SPACE:
                attrs, by, at = self._attributes(at, name)
            elif by == "/":
                if text[at : at + 1] != ">":
                    raise Failure(f"'>' expected after <{name}/", at)
                at += 1
            yield Event("ELEMENT_OPEN", "ELEMENT", name, attrs)
            rooted = True
            if by == "/":
                yield Event("ELEMENT_CLOSE", "ELEMENT", name)
                rooted &= not (sax and not stack)
            elif by:
                stack.append((name, dict(attrs)))
                kind = self._type(stack[-1], kind, "TEXT")
                kinds.append(kind)
        self._close(stack, base, len(text))

    def _close(self, stack: list, base: int, at: int) -> None:
        """At the end nothing below the outermost open node may be open."""
        if len(stack) > max(base, 1):
            raise Failure(f"Close tag </{stack[-1][0]}> is missing", at)


def nodes(events: Iterator[Event], under: bool = False) -> list[list]:
    """Rows [node_id, parent_id, last_desc, depth, ord, node_type, name, attrs, str_value, int_value, real_value, ws, custom] of a document's events.

    The first directive or declaration outside of elements holds what follows it, but not in a fragment `under` a node.
    """
    rows: list[list] = []
    open_: list[int] = []
    children: list[int] = [0]
    for e in events:
        if e.event == "ELEMENT_CLOSE":
            rows[open_.pop()][2] = len(rows) - 1
            children.pop()
            continue
        if e.node_type is None:
            continue
        i = len(rows)
        rows.append([i, open_[-1] if open_ else None, i, len(open_), children[-1], e.node_type, e.name, e.attrs, *e[4:]])
        children[-1] += 1
        if e.event == "ELEMENT_OPEN" or not under and not open_ and e.event in ("DIRECTIVE", "DECLARATION"):
            open_.append(i)
            children.append(0)
    for i in open_:
        rows[i][2] = len(rows) - 1
    return rows


_NAME = "[A-Za-z_][A-Za-z0-9_.:-]*"
#: A tag of plain names and values, and the value up to the next one; or a character that begins something else.
_TOKEN = re.compile(f"<(/?)({_NAME})((?: {_NAME}=\"[^\"&<]*\")*)(/?)>([^<]*)|(.)", re.DOTALL)
_PAIR = re.compile(f" ({_NAME})=\"([^\"]*)\"")
_HEAD = re.compile("<[?]([^?<>]+)[?]>(?=<)")
_LEAD = re.compile("[^<]*")


def plain_rows(doc_id: str, text: str, options: LoadOptions, top: tuple[str, dict] | None = None) -> list[list] | None:
    """The same rows as nodes() of a Scanner gives, between doc_id and a null, for a document of nothing but plain tags and values; None if it isn't
    one, or can't be loaded. It takes a fraction of the Scanner's time, as one expression cuts the whole text."""
    if not text.endswith(">"):
        return None
    rows: list[list] = []
    open_: list[int] = []
    kids, names, kinds = [0], [], []
    type_of, fixed = options.type_of, options.value_type or "TEXT"
    at, kind, rooted = 0, fixed, False
    if top:
        kind = type_of(*top) if type_of else options.value_type or "IGNORE"
        names.append(top[0]), kinds.append(kind)
    elif m := _HEAD.match(text):
        rows.append([doc_id, 0, None, 0, 0, 0, "DIRECTIVE", None, None, m[1], None, None, None, None, None])
        open_.append(0), kids.append(0)
        at = m.end()
    base, head, whole_numbers = len(names), bool(rows), {"INTEGER": (10, int), "REAL": (11, float)}

    def put(run: str) -> bool:
        """A value's nodes; False if it is none that can be loaded here."""
        if kind == "IGNORE" and "&" not in run:
            return True
        if kind in ("OPAQUE", "CUSTOM") or not _SPLIT.search(run):
            tokens, trailing = [(run, False)], False
        else:
            parts = _SPLIT.split(run)
            trailing = not parts[-1]
            tokens = [(p, i > 0) for i, p in enumerate(parts) if p]
        up, depth = open_[-1] if open_ else None, len(open_)
        for token, ws in tokens:
            token = unescape(token, options) if "&" in token else token
            row = [doc_id, len(rows), up, len(rows), depth, kids[-1], kind, None, None, None, None, None, None, None, None]
            if kind == "TEXT":
                row[9], row[12] = token, ws
            elif kind == "OPAQUE":
                row[9] = token
            elif kind in ("INTEGER", "REAL"):
                row[10 if kind == "INTEGER" else 11], whole = (integer if kind == "INTEGER" else real)(token)
                if not whole:
                    return False
            elif kind == "IGNORE":
                continue
            else:
                row[13] = options.custom_load(token) if kind == "CUSTOM" and options.custom_load else None
                if row[13] is None:
                    return False
            rows.append(row)
            kids[-1] += 1
        if trailing and kind == "TEXT":
            rows.append([doc_id, len(rows), up, len(rows), depth, kids[-1], "TEXT", None, None, "", None, None, True, None, None])
            kids[-1] += 1
        return True

    try:
        if top and (lead := _LEAD.match(text)[0]):
            at = len(lead)
            if not put(lead):
                return None
        for shut, name, attrs, closed, run, other in _TOKEN.findall(text, at):
            if shut:
                if attrs or closed or len(names) <= base or names.pop() != name:
                    return None
                rows[open_.pop()][3] = len(rows) - 1
                kids.pop(), kinds.pop()
                if type_of and kinds:
                    kind = kinds[-1]
            elif other or rooted and not names:
                return None
            else:
                pairs: list[tuple[str, str]] = []
                if attrs:
                    pairs = _PAIR.findall(attrs)
                    if len(pairs) > 1 and len({p[0] for p in pairs}) < len(pairs):
                        return None
                i, rooted = len(rows), True
                rows.append([doc_id, i, open_[-1] if open_ else None, i, len(open_), kids[-1], "ELEMENT", name, pairs, None, None, None, None, None, None])
                kids[-1] += 1
                if not closed:
                    open_.append(i), kids.append(0), names.append(name)
                    kind = type_of(name, dict(pairs)) if type_of else fixed
                    kinds.append(kind)
            if not run:
                continue
            if names and kind in whole_numbers and run.isdigit() and run.isascii() and run[0] != "0" and len(run) < 16:
                row = [doc_id, len(rows), open_[-1] if open_ else None, len(rows), len(open_), kids[-1], kind, None, None, None, None, None, None, None, None]
                row[whole_numbers[kind][0]] = whole_numbers[kind][1](run)
                rows.append(row)
                kids[-1] += 1
            elif not names or not put(run):
                return None
    except Failure:
        return None
    if len(names) > base or not rooted:
        return None
    if head:
        rows[0][3] = len(rows) - 1
    return rows
