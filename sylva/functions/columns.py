"""Plain documents of a batch to node columns by array operations over all their bytes; what isn't plain is left to the scanner.

Plain is what scan.plain_rows() takes, but for references, custom values and numbers that aren't a few digits. A text is cut at its angle brackets;
levels are a running sum of tags, a tag's element and parent the last one opened a level above.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from sylva.functions.schema import LoadOptions

#: So many bytes of documents are cut at once.
SLICE = 1 << 21
_NAMED = re.compile("[A-Za-z_][A-Za-z0-9_.:-]*")
_KINDS = ("TEXT", "OPAQUE", "INTEGER", "REAL", "IGNORE")
_TYPES = pa.array([*_KINDS, "ELEMENT", "DIRECTIVE"])
_TEXT, _OPAQUE, _INTEGER, _REAL, _IGNORE, _ELEMENT, _DIRECTIVE, _OTHER = range(8)
_BLANK, _ODD = np.zeros(256, bool), np.zeros(256, bool)
_BLANK[[9, 10, 13, 32]] = True
_ODD[:32] = _ODD[[ord("&"), 0xEF]] = True  # control characters, references, and what a byte order mark begins with
_ODD[[9, 10, 13]] = False
DEEP, DIGITS, PAIRS = 60_000, 15, 16


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of some SLICE bytes of a string column."""
    ends = np.frombuffer(batch.column(column).buffers()[1], np.int32)[batch.column(column).offset :][: batch.num_rows + 1]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray, valid: np.ndarray | None = None) -> pa.StringArray:
    size = end - start
    at = np.concatenate([[0], np.cumsum(size)])
    held = data[np.arange(at[-1]) + np.repeat(start - at[:-1], size)]
    bits = None if valid is None else pa.py_buffer(np.packbits(valid, bitorder="little"))
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(held), bits)


def _codes(names: pa.StringArray) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Numbers of names, the names by number, and which of these are plain."""
    d = names.dictionary_encode()
    values = d.dictionary.to_pylist()
    return d.indices.to_numpy(), values, np.array([_NAMED.fullmatch(v) is not None for v in values], bool)


def plain_columns(texts: pa.StringArray, options: LoadOptions, kinds: Mapping[str, pa.DataType], ignored: bool = True) -> tuple[np.ndarray, np.ndarray, dict[str, pa.Array]]:
    """Which documents are plain; of their nodes the number of the document; and of the node table's columns those in kinds (but doc_id).

    ignored: False if documents with values of type IGNORE, which give events but no nodes, don't count as plain.
    """
    n = len(texts)
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset :][: n + 1].astype(np.int64)
    whole = texts.buffers()[2]
    data = np.frombuffer(whole, np.uint8)[ends[0] : ends[-1]] if whole is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    ok = ends[1:] > ends[:-1]
    of = lambda at: np.searchsorted(ends, at, "right") - 1
    odd = np.flatnonzero(_ODD[data])
    ok[of(odd)] = False
    left, right = np.flatnonzero(data == ord("<")), np.flatnonzero(data == ord(">"))
    left_of, right_of = of(left), of(right)
    ok &= np.bincount(left_of, minlength=n) == np.bincount(right_of, minlength=n)
    lt, gt, doc = left[ok[left_of]], right[ok[right_of]], left_of[ok[left_of]]
    if len(lt):
        bad = lt >= gt
        bad[1:] |= gt[:-1] >= lt[1:]
        ok[doc[bad]] = False
        first, last = np.ones(len(lt), bool), np.ones(len(lt), bool)
        first[1:] = last[:-1] = doc[1:] != doc[:-1]
        ok[doc[first & (lt != ends[doc])]] = False
        ok[doc[last & (gt != ends[doc + 1] - 1)]] = False
        seen = np.zeros(n, bool)
        seen[doc] = True
        ok &= seen
    else:
        ok[:] = False
    keep = ok[doc]
    lt, gt, doc = lt[keep], gt[keep], doc[keep]
    if not len(lt):
        return ok, np.zeros(0, np.int64), {}
    first, last = np.ones(len(lt), bool), np.ones(len(lt), bool)
    first[1:] = last[:-1] = doc[1:] != doc[:-1]

    # Tags: </name>, <name a="b"/>, and <?..?> at the start.
    lead = data[lt + 1]
    close, head = lead == ord("/"), lead == ord("?")
    alone = ~close & ~head & (data[gt - 1] == ord("/"))
    until = gt - alone
    blanks = np.append(np.flatnonzero(data == 32), len(data) + 1)
    blank = blanks[np.searchsorted(blanks, lt)]
    given = ~close & ~head & (blank < until)
    bad = head & (~first | last | (data[gt - 1] != ord("?")) | (gt - lt < 4))
    bad[:-1] |= head[:-1] & (gt[:-1] + 1 != lt[1:])
    questions = np.concatenate([[0], np.cumsum(data == ord("?"))])
    bad |= head & (questions[gt] - questions[lt] != 2)
    name_at, name_to = lt + 1 + close, np.where(given, blank, until)
    name_to = np.where(head, name_at, name_to)
    name, names, plain = _codes(_strings(data, name_at, np.maximum(name_to, name_at)))
    bad |= ~head & ~plain[name]
    quote = np.flatnonzero(data == ord('"'))
    tag = np.searchsorted(lt, quote, "right") - 1
    inside = (tag >= 0) & (quote < gt[tag])
    quote, tag = quote[inside], tag[inside]
    inside = given[tag]
    bad[tag[~inside & ~head[tag]]] = True
    quote, tag = quote[inside], tag[inside]
    count = np.bincount(tag, minlength=len(lt))
    bad |= (given & (count == 0)) | (count % 2 == 1) | (count > 2 * PAIRS)
    even = (count % 2 == 0)[tag]
    quote, tag = quote[even], tag[even]
    open_quote, shut_quote, tag = quote[::2], quote[1::2], tag[::2]
    begins = np.ones(len(tag), bool)
    begins[1:] = tag[1:] != tag[:-1]
    pair_at = np.where(begins, blank[tag] + 1, np.concatenate([[0], shut_quote[:-1]]) + 2) if len(tag) else tag
    finishes = np.append(begins[1:], True) if len(tag) else begins
    wrong = (data[open_quote - 1] != ord("=")) | (pair_at >= open_quote)
    wrong |= np.where(finishes, shut_quote + 1 != until[tag], data[np.minimum(shut_quote + 1, len(data) - 1)] != 32)
    key, keys, plain = _codes(_strings(data, pair_at, np.maximum(open_quote - 1, pair_at)))
    wrong |= ~plain[key] if len(key) else False
    for lag in range(1, int(count.max()) // 2):
        same = (tag[lag:] == tag[:-lag]) & (key[lag:] == key[:-lag])
        wrong[lag:] |= same
    bad[tag[wrong]] = True

    # Levels: of an element its depth below the root.
    step = np.where(close, -1, np.where(alone | head, 0, 1))
    total = np.cumsum(step)
    after = total - (total - step)[np.flatnonzero(first)][np.cumsum(first) - 1]
    level = np.where(close, after, after - step)
    bad |= (after < 0) | (last & (after != 0)) | (level > DEEP)
    roots = np.bincount(doc[~close & ~head & (level == 0)], minlength=n)
    ok[doc[bad]] = False
    ok &= roots == 1
    keep = ok[doc]
    if not keep.all():
        pairs = keep[tag]
        tag = (np.cumsum(keep) - 1)[tag[pairs]]
        key, open_quote, shut_quote = key[pairs], open_quote[pairs], shut_quote[pairs]
        lt, gt, doc, close, head, alone, name, level, first, last = (x[keep] for x in (lt, gt, doc, close, head, alone, name, level, first, last))
    if not len(lt):
        return ok, np.zeros(0, np.int64), {}
    size = len(lt)
    opened = np.flatnonzero(~close & ~alone & ~head)
    opened = opened[np.argsort(level[opened].astype(np.uint16), kind="stable")]
    places = level[opened] * size + opened
    above = lambda at, tags: opened[np.maximum(np.searchsorted(places, at * size + tags, "right") - 1, 0)] if len(opened) else np.zeros(len(tags), np.int64)
    every, shut = np.arange(size), np.flatnonzero(close)
    parent = np.where(level > 0, above(level - 1, every), -1)
    match = above(level[shut], shut)
    ok[doc[shut[name[match] != name[shut]]]] = False
    ended = every.copy()
    ended[match] = shut
    around = np.where(alone, parent, every)
    around[shut] = parent[match]

    # Values: what stands between two tags.
    run = np.flatnonzero((gt[:-1] + 1 < lt[1:]) & ~last[:-1])
    start, end, holder = gt[run] + 1, lt[run + 1], around[run]
    outside = (holder < 0) | head[holder]
    ok[doc[run[outside]]] = False
    start, end, holder = start[~outside], end[~outside], holder[~outside]
    kind = _types(options, holder, name, names, tag, lambda i: (keys[key[i]], bytes(data[open_quote[i] + 1 : shut_quote[i]]).decode()))
    ok[doc[holder[(kind == _OTHER) | (kind == _IGNORE) & (not ignored)]]] = False
    number = (kind == _INTEGER) | (kind == _REAL)
    value = np.zeros(len(kind), np.int64)
    if number.any():
        value[number], well = _digits(data, start[number], end[number])
        ok[doc[holder[number]][~well]] = False
    parts = [(start[x], end[x], holder[x], kind[x], value[x], np.zeros(int(x.sum()), bool)) for x in (number | (kind == _OPAQUE),)]
    text = kind == _TEXT
    if text.any():
        parts += _words(data, start[text], end[text], holder[text])
    start, end, holder, kind, value, blank_before = (np.concatenate(x) for x in zip(*parts))
    keep = ok[doc[holder]]
    start, end, holder, kind, value, blank_before = (x[keep] for x in (start, end, holder, kind, value, blank_before))

    # Nodes, in the order of their first characters. An empty word stands at the blank before it.
    element = np.flatnonzero(~close & ok[doc])
    at = np.where(start == end, start - 1, start)
    mark = np.zeros(len(data), bool)
    mark[lt[element]] = mark[at] = True
    rank = np.cumsum(mark) - 1
    total = int(rank[-1]) + 1
    if not total:
        return ok, np.zeros(0, np.int64), {}
    node_tag, node_value = rank[lt], rank[at]
    here = node_tag[element]
    node_doc = np.empty(total, np.int64)
    node_doc[here], node_doc[node_value] = doc[element], doc[holder]
    begins = np.ones(total, bool)
    begins[1:] = node_doc[1:] != node_doc[:-1]
    starts = np.flatnonzero(begins)
    which = np.cumsum(begins) - 1
    base, final = starts[which], np.append(starts[1:], total)[which] - 1
    headed = np.zeros(n, bool)
    headed[doc[head]] = True
    depth, up, end_of = np.zeros(total, np.int64), np.empty(total, np.int64), np.arange(total)
    extra = headed[doc[element]] & ~head[element]
    depth[here] = level[element] + extra
    depth[node_value] = level[holder] + 1 + headed[doc[holder]]
    up[here] = np.where(parent[element] >= 0, node_tag[parent[element]], np.where(extra, base[here], -1))
    up[node_value] = node_tag[holder]
    end_of[here] = np.where(head[element], final[here], np.where(alone[element], here, rank[lt[ended[element]]]))
    out: dict[str, pa.Array] = {}
    none = up < 0
    if "node_id" in kinds:
        out["node_id"] = pa.array(np.arange(total) - base)
    if "parent_id" in kinds:
        out["parent_id"] = pa.array(up - base, mask=none)
    if "last_desc" in kinds:
        out["last_desc"] = pa.array(end_of - base)
    if "depth" in kinds:
        out["depth"] = pa.array(depth.astype(np.int32))
    if "ord" in kinds:
        # On a level, the children of one parent follow each other.
        order = np.argsort(depth.astype(np.uint16), kind="stable")
        family = np.where(none, -1 - node_doc, up)[order]
        eldest = np.ones(total, bool)
        eldest[1:] = family[1:] != family[:-1]
        place = np.empty(total, np.int32)
        place[order] = np.arange(total) - np.flatnonzero(eldest)[np.cumsum(eldest) - 1]
        out["ord"] = pa.array(place)
    types = np.full(total, _ELEMENT, np.int8)
    types[here[head[element]]] = _DIRECTIVE
    types[node_value] = kind
    if "node_type" in kinds:
        out["node_type"] = pa.DictionaryArray.from_arrays(pa.array(types), _TYPES).dictionary_decode()
    if "name" in kinds:
        code = np.zeros(total, np.int32)
        code[here] = name[element]
        out["name"] = pa.DictionaryArray.from_arrays(pa.array(code, mask=types != _ELEMENT), pa.array(names, pa.string())).dictionary_decode()
    if "attrs" in kinds:
        good = ok[doc[tag]]
        counts = np.bincount(node_tag[tag[good]], minlength=total)
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), mask=np.append(types != _ELEMENT, False))
        own = pa.DictionaryArray.from_arrays(pa.array(key[good].astype(np.int32)), pa.array(keys, pa.string())).dictionary_decode()
        each = pa.StructArray.from_arrays([own, _strings(data, open_quote[good] + 1, shut_quote[good])], fields=list(kinds["attrs"].value_type))
        out["attrs"] = pa.ListArray.from_arrays(offsets, each, type=kinds["attrs"])
    if "str_value" in kinds:
        low, high, valid = np.zeros(total, np.int64), np.zeros(total, np.int64), (types == _TEXT) | (types == _OPAQUE) | (types == _DIRECTIVE)
        said = (kind == _TEXT) | (kind == _OPAQUE)
        low[node_value[said]], high[node_value[said]] = start[said], end[said]
        heads = element[head[element]]
        low[node_tag[heads]], high[node_tag[heads]] = lt[heads] + 2, gt[heads] - 1
        out["str_value"] = _strings(data, low, high, valid)
    numbers = np.zeros(total, np.int64)
    numbers[node_value] = value
    if "int_value" in kinds:
        out["int_value"] = pa.array(numbers, mask=types != _INTEGER)
    if "real_value" in kinds:
        out["real_value"] = pa.array(numbers.astype(np.float64), mask=types != _REAL)
    if "ws" in kinds:
        spaced = np.zeros(total, bool)
        spaced[node_value] = blank_before
        out["ws"] = pa.array(spaced, mask=types != _TEXT)
    for c in ("custom", "user_data"):
        if c in kinds:
            out[c] = pa.nulls(total, kinds[c])
    return ok, node_doc, out


class Places(NamedTuple):
    """Rows of whole documents in pre-order, of which some may be missing: each one's document, rank, parent (-1: none), last descendant and name's number (-1: no element), and what these numbers are of."""

    doc: np.ndarray
    node: np.ndarray
    parent: np.ndarray
    last: np.ndarray
    name: np.ndarray
    names: dict[str | None, int]

    def follow(self, tops: np.ndarray, steps: Sequence[tuple[str, bool]]) -> tuple[list[np.ndarray], np.ndarray]:
        """From a row of each document (tops), the rows that a slash path's segments (name, at any depth) match first, and those that it leads to."""
        passed, at = [], tops
        for name, deep in steps:
            here, until = np.where(at >= 0, self.node[at], -2), np.where(at >= 0, self.last[at], -2)
            met = np.flatnonzero(self.name == self.names.get(name, -2))
            of = self.doc[met]
            inside = (self.node[met] > here[of]) & (self.node[met] <= until[of]) if deep else self.parent[met] == here[of]
            of, first = np.unique(of[inside], return_index=True)
            passed.append(met[inside][first])
            at = np.full(len(tops), -1)
            at[of] = passed[-1]
        at = at[at >= 0]
        after = np.minimum(at + 1, len(self.node) - 1)
        value = (self.doc[after] == self.doc[at]) & (self.node[after] == self.node[at] + 1) & (self.node[after] <= self.last[at]) & (self.name[after] < 0)
        return passed, np.where(value, after, at)


def passed(made: Mapping[str, pa.Array], paths: Sequence[Sequence[tuple[str, bool]]]) -> np.ndarray:
    """Which nodes of whole documents slash paths from the root pass or lead to, and the roots."""
    node, named = made["node_id"].to_numpy(), made["name"].dictionary_encode()
    keep, names = node == 0, {name: i for i, name in enumerate(named.dictionary.to_pylist())}
    tops = np.flatnonzero(keep)
    places = Places(np.cumsum(keep) - 1, node, made["parent_id"].fill_null(-1).to_numpy(), made["last_desc"].to_numpy(), named.indices.fill_null(-1).to_numpy(), names)
    for steps in paths:
        rows, ends = places.follow(tops, steps)
        keep[np.concatenate([*rows, ends])] = True
    return keep


def _types(options: LoadOptions, holder: np.ndarray, name: np.ndarray, names: list[str], tag: np.ndarray, pair: Callable[[int], tuple[str, str]]) -> np.ndarray:
    """The kinds of values by the elements that hold them. A function is asked once for each name without attributes, else once for each element."""
    numbers = {k: i for i, k in enumerate(_KINDS)}
    if not options.type_of:
        return np.full(len(holder), numbers.get(options.value_type or "TEXT", _OTHER))
    low, high = np.searchsorted(tag, holder, "left"), np.searchsorted(tag, holder, "right")
    out, bare = np.full(len(holder), _OTHER), low == high
    by_name = np.full(len(names), _OTHER)
    for i in np.unique(name[holder[bare]]).tolist():
        by_name[i] = numbers.get(options.type_of(names[i], {}), _OTHER)
    out[bare] = by_name[name[holder[bare]]]
    before, same = -1, _OTHER
    for i in np.flatnonzero(~bare).tolist():
        if holder[i] != before:
            before, same = holder[i], numbers.get(options.type_of(names[name[holder[i]]], dict(map(pair, range(low[i], high[i])))), _OTHER)
        out[i] = same
    return out


def _digits(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of few decimal digits, and which are such."""
    size = end - start
    well = (size <= DIGITS) & ((data[start] != ord("0")) | (size == 1))
    value = np.zeros(len(start), np.int64)
    for k in range(min(DIGITS, int(size.max()))):
        some = size > k
        d = data[np.where(some, end - 1 - k, start)].astype(np.int64) - ord("0")
        well &= ~some | (d >= 0) & (d <= 9)
        value += np.where(some, d, 0) * 10**k
    return value, well


def _words(data: np.ndarray, start: np.ndarray, end: np.ndarray, holder: np.ndarray) -> list[tuple]:
    """Words of values (start, end, holder, kind, 0, whether a blank is before), and an empty one after each that ends in a blank."""
    edge = np.zeros(len(data) + 1, np.int8)
    edge[start] += 1
    edge[end] -= 1
    within = np.cumsum(edge[:-1], dtype=np.int8).astype(bool) & ~_BLANK[data]
    starts, ends = within.copy(), within.copy()
    starts[1:] &= ~within[:-1]
    ends[:-1] &= ~within[1:]
    low, high = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    of = np.searchsorted(start, low, "right") - 1
    trail = _BLANK[data[end - 1]]
    none = lambda x: np.zeros(len(x), np.int64)
    texts = lambda x: np.full(len(x), _TEXT)
    empty = end[trail]
    return [(low, high, holder[of], texts(low), none(low), low > start[of]), (empty, empty, holder[trail], texts(empty), none(empty), np.ones(len(empty), bool))]


def said(column: pa.Array) -> Iterator[str | None]:
    """A column's strings, each made once."""
    d = column.dictionary_encode()
    return map([*d.dictionary.to_pylist(), None].__getitem__, d.indices.fill_null(-1).to_numpy().tolist())
