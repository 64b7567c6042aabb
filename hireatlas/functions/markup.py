"""A byte-level HTML and XML tokenizer over Arrow batches, and what pages are read for.

A batch of pages is one byte array. The state machine "which `<` begins a tag, where does it end, where does the next one begin" is
solved for all of them at once: every `<` has one follow-up position, the same wherever the machine comes from, and the positions
reached from each page start are marked by doubling the steps. Quoted attribute values are skipped the same way. Time grows with the bytes
(times the logarithm of the longest chain of tags), also for pages of nothing but unclosed tags, and no page is cut.

The tokens: a tag is ``<`` followed by a letter, ``/``, ``!`` or ``?`` up to its ``>``, where a quote counts only behind ``=`` and a quoted
value may hold ``>``; without an end it is text. Comments, and the contents of script and style, are no text; an unclosed one reaches to
the end of the page. Marked sections (``<![CDATA[``) are text. Text nodes have their references decoded, are trimmed and joined by one
space. An element (title, h1) ends at its end tag, or with its parent, or with the page; an anchor at the next anchor tag.

A null page has null parts, an empty one empty text and lists; a page without an ``h1`` has a null heading.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from html import unescape
from html.entities import html5

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F

from hireatlas.functions.workers import GIVE_BACK_BYTES, give_back

# Tasks get this code with the function, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: What can be read of a page.
PARTS = {
    "title": "string",
    "heading": "string",
    "text": "string",  # without script, style and noscript
    "body": "string",  # keeps noscript, as the consent and job-signal tests read it
    "links": "array<struct<href:string,text:string>>",
    "data_blocks": "array<string>",  # bodies of application/ld+json scripts
    "locations": "array<string>",  # loc elements of a sitemap
}
#: Pages are worked on together up to so many bytes; the arrays of a chunk take some dozens of bytes a byte.
CHUNK_BYTES = 1 << 18
FAR = np.int64(1) << 60

_BYTE = np.arange(256)
_SPACE = (_BYTE == 32) | ((_BYTE >= 9) & (_BYTE <= 13))
_LETTER = ((_BYTE >= 65) & (_BYTE <= 90)) | ((_BYTE >= 97) & (_BYTE <= 122))
_OPENS = _LETTER | np.isin(_BYTE, list(b"/!?"))
_ENDS_NAME = _SPACE | np.isin(_BYTE, [0, *b"/>"])
_LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)

#: Names that are told apart; 0 is any other.
NAMES = ["", "script", "style", "noscript", "title", "h1", "a", "loc"]
_CODE = {name: code for code, name in enumerate(NAMES)}
# Elements of the HTML standard that have no content.
_VOID = frozenset(b"area base br col embed hr img input link meta source track wbr".split())
_NAME = re.compile(rb"</?([A-Za-z][^\s/>]*)")
_VALUE = rb"""(?:"[^"]*+"|'[^']*+'|[^\s>]*+)"""
_REFERENCE = re.compile(r"&(?:#(?:[0-9]++|[xX][0-9a-fA-F]++);?|[A-Za-z][A-Za-z0-9]*+(?:;|(?!=)))")
_EDGE = "\udcff"  # the byte 0xFF, which no text holds, decoded by surrogateescape

START, END, OTHER = 1, 2, 0


def _attribute(element: bytes, name: bytes) -> re.Pattern[bytes]:
    """The value of the first attribute of that name, at the start of a tag."""
    other = rb"[\s/]*+(?!" + name + rb"[\s=])[^\s/>][^\s/>=]*+(?:\s*+=\s*+" + _VALUE + rb")?+"
    return re.compile(rb"(?is)<" + element + rb"(?=[\s/])(?:" + other + rb")*+[\s/]*+" + name + rb"\s*+=\s*+(" + _VALUE + rb")")


_HREF, _TYPE = _attribute(b"a", b"href"), _attribute(b"script", b"type")


def _attribute_text(value: bytes) -> str:
    text = value.decode("utf-8", "replace")
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        text = text[1:-1]
    if "&" not in text:
        return text
    # In a value, a name without its semicolon counts only if it is a whole one ("&copy=" is a parameter).
    return _REFERENCE.sub(lambda m: unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0], text)


def _next(positions: np.ndarray, at: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """The first of the sorted positions from `at` on and before `limit`, else FAR."""
    found = np.append(positions, FAR)[np.searchsorted(positions, at)]
    return np.where(found < limit, found, FAR)


def _pattern(data: np.ndarray, text: bytes) -> np.ndarray:
    """Where a short byte string stands."""
    at = np.flatnonzero(data[: max(0, len(data) - len(text) + 1)] == text[0])
    for k, byte in enumerate(text[1:], 1):
        at = at[data[at + k] == byte]
    return at


class Tokens:
    """Tokens of the pages in `data`; page i lies from `offsets[i]` to `offsets[i + 1]`.

    `start`, `stop`, `kind`, `code`, `page` of each token, in order. Every page begins with a token of no length, so the text
    behind token i, from `stop[i]` to `gap_end[i]`, covers what lies between tokens.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        at = np.flatnonzero(data == 0x3C)
        at = at[_OPENS[padded[at + 1]]]
        page = np.searchsorted(offsets, at, "right") - 1
        inside = at + 1 < offsets[page + 1]
        at, page = at[inside], page[inside]
        limit = offsets[page + 1]

        second = padded[at + 1]
        closing = second == 0x2F
        behind = (at + 1 + closing)[:, None] + np.arange(9)
        names = np.where(behind < limit[:, None], _LOWER[padded[behind]], np.uint8(0))
        code = np.zeros(len(at), np.int8)
        for name, number in list(_CODE.items())[1:]:
            same = _ENDS_NAME[names[:, len(name)]]
            for k, byte in enumerate(name.encode()):
                same &= names[:, k] == byte
            code[same] = number
        kind = np.where(closing, END, np.where(_LETTER[second], START, OTHER)).astype(np.int8)

        close = self._tag_ends(data, offsets, at, limit)
        tag = close < FAR
        stop = np.where(tag, close + 1, at + 1)
        comment = (second == 0x21) & (padded[at + 2] == 0x2D) & (padded[at + 3] == 0x2D) & (at + 4 <= limit)
        marked = (second == 0x21) & (padded[at + 2] == 0x5B) & (at + 9 <= limit)
        if marked.any():
            marked &= np.isin(at, _pattern(data, b"<![CDATA["))
        for which, end in ((comment, b"-->"), (marked, b"]]>")):
            if which.any():
                found = _next(_pattern(data, end), at[which] + (4 if which is comment else 9), limit[which] - 2)
                stop[which] = np.where(found < FAR, found + 3, limit[which])
                tag[which] = True
                code[which], kind[which] = 0, OTHER

        # Where the machine goes on behind each `<`.
        onward = stop.copy()
        for name in ("script", "style"):
            opening = (kind == START) & (code == _CODE[name])
            if opening.any():
                ends = at[(kind == END) & (code == _CODE[name])]
                found = _next(ends, stop[opening], limit[opening])
                onward[opening] = np.where(tag[opening] & (found < FAR), found, limit[opening])
                stop[opening] = np.where(tag[opening], stop[opening], limit[opening])
                tag[opening] = True
        step = np.append(np.searchsorted(at, onward), len(at))
        step[:-1][np.append(at, FAR)[step[:-1]] >= limit] = len(at)
        reached = np.zeros(len(at) + 1, bool)
        first = np.searchsorted(at, offsets[:-1])
        reached[first[np.append(at, FAR)[first] < offsets[1:]]] = True
        while (step < len(at)).any():
            reached[step[np.flatnonzero(reached)]] = True
            step = step[step]
        reached = reached[:-1]
        #: A `<` that begins no tag because none ends.
        self.loose = at[reached & ~tag]

        keep = reached & tag
        start, stop, kind, code, page, marked = at[keep], stop[keep], kind[keep], code[keep], page[keep], marked[keep]
        if marked.any():
            # Two tokens, so that what lies between them is text.
            whole = ~np.isin(stop[marked], offsets[1:]) | (self._ends_with(data, stop[marked], b"]]>"))
            ends = np.where(whole, stop[marked] - 3, stop[marked])
            extra = np.stack([ends, stop[marked], np.zeros_like(ends), np.zeros_like(ends), page[marked]])
            stop[marked] = np.minimum(start[marked] + 9, ends)
            start, stop, kind, code, page = (np.concatenate([a, b]) for a, b in zip((start, stop, kind, code, page), extra))
        pages = np.arange(len(offsets) - 1)
        none = np.zeros(len(pages), np.int8)
        start, stop = np.concatenate([offsets[:-1], start]), np.concatenate([offsets[:-1], stop])
        kind, code, page = np.concatenate([none, kind]), np.concatenate([none, code]), np.concatenate([pages, page])
        order = np.lexsort((np.arange(len(start)), start, page))
        self.start, self.stop, self.kind, self.code, self.page = (x[order] for x in (start, stop, kind, code, page))
        self.first = np.searchsorted(self.page, np.arange(len(offsets)))
        self.gap_end = np.minimum(np.append(self.start[1:], FAR), offsets[self.page + 1])
        raw = (self.kind == START) & ((self.code == _CODE["script"]) | (self.code == _CODE["style"]))
        filled = np.concatenate([[0], np.cumsum(~_SPACE[data], dtype=np.int64)])
        #: Whether the text behind a token is one, and not blank.
        self.is_text = ~raw & (filled[self.gap_end] > filled[np.minimum(self.stop, self.gap_end)])

    @staticmethod
    def _ends_with(data: np.ndarray, stop: np.ndarray, text: bytes) -> np.ndarray:
        return np.all([data[np.maximum(stop - len(text) + k, 0)] == byte for k, byte in enumerate(text)], axis=0)

    @staticmethod
    def _tag_ends(data, offsets, at, limit) -> np.ndarray:
        """For each `<` the `>` that ends its tag, else FAR."""
        more = np.flatnonzero(data == 0x3E)
        quotes = np.flatnonzero((data == 0x22) | (data == 0x27))
        before = quotes - 1
        blank = (before >= 0) & _SPACE[data[np.maximum(before, 0)]]
        if blank.any():
            solid = np.flatnonzero(~_SPACE[data])
            before[blank] = np.append(-1, solid)[np.searchsorted(solid, quotes[blank])]
        page = np.searchsorted(offsets, quotes, "right") - 1
        valued = (before >= offsets[page]) & (data[np.maximum(before, 0)] == 0x3D)
        quotes, equals, until = quotes[valued], before[valued], offsets[page[valued] + 1]
        ends = np.full(len(quotes), FAR)
        for byte in (0x22, 0x27):
            own = data[quotes] == byte
            ends[own] = _next(np.flatnonzero(data == byte), quotes[own] + 1, until[own])
        closed = ends < FAR
        equals, ends, until = equals[closed], ends[closed], until[closed]
        # Behind the value that begins at equals[i]: the next `>`, unless another value begins before it.
        follower = np.searchsorted(equals, ends, "right")
        found = _next(more, ends + 1, until)
        following = np.append(equals, FAR)[follower]
        open_ = (following < until) & (following < found)
        todo = np.flatnonzero(open_)
        while len(todo):
            target = follower[todo]
            known = ~open_[target]
            done, rest = todo[known], todo[~known]
            found[done] = found[target[known]]
            follower[rest] = follower[target[~known]]
            open_[done] = False
            todo = rest
        close = _next(more, at + 1, limit)
        value = np.searchsorted(equals, at, "right")
        first = np.append(equals, FAR)[value]
        return np.where((first < limit) & (first < close), np.append(found, FAR)[value], close)


class Pages:
    """Reads the parts of the pages of one token array."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.tokens = t = Tokens(data, offsets)
        self.raw = data.tobytes()
        self.start, self.stop, self.gap_end = t.start.tolist(), t.stop.tolist(), t.gap_end.tolist()
        self.is_text = t.is_text
        self.count = len(offsets) - 1

    def _joined(self, spans: list[tuple[int, int]]) -> str:
        raw = self.raw
        text = b"\xff".join([raw[a:b] for a, b in spans]).decode("utf-8", "surrogateescape")
        if "&" in text:
            text = unescape(text)
        return " ".join(filter(None, map(str.strip, text.split(_EDGE))))

    def _spans(self, tokens) -> list[tuple[int, int]]:
        return [(self.stop[i], self.gap_end[i]) for i in tokens]

    def _of_name(self, name: str, kind: int) -> np.ndarray:
        return np.flatnonzero((self.tokens.kind == kind) & (self.tokens.code == _CODE[name]))

    def _whole(self, keep: np.ndarray) -> list[str]:
        at = np.flatnonzero(keep)
        bounds = np.searchsorted(at, self.tokens.first).tolist()
        at = at.tolist()
        return [self._joined(self._spans(at[a:b])) for a, b in zip(bounds, bounds[1:])]

    def body(self) -> list[str]:
        return self._whole(self.is_text)

    def text(self) -> list[str]:
        t = self.tokens
        noscript = t.code == _CODE["noscript"]
        if not noscript.any():
            return self.body()
        # The last page start or noscript tag up to each token tells whether the text behind it is inside.
        turns = noscript | (t.kind == OTHER) & (t.start == t.offsets[t.page]) & (t.stop == t.start)
        last = np.maximum.accumulate(np.where(turns, np.arange(len(turns)), 0))
        return self._whole(self.is_text & ~(noscript[last] & (t.kind[last] == START)))

    def _element_end(self, i: int, name: str) -> int:
        """The token that ends the element of start tag i: its end tag, an end tag of an element around it, or the end of the page."""
        t, raw = self.tokens, self.raw
        page = t.page[i]
        begin, last = int(t.first[page]), int(t.first[page + 1])
        own, around = name.encode(), None
        depth = Counter({own: 1})

        def tags(indices):
            for j in indices:
                found = _NAME.match(raw, self.start[j], self.stop[j])
                if found and found[1].lower() not in _VOID:
                    yield j, t.kind[j] == START, found[1].lower()

        for j, opens, tag in tags(range(i + 1, last)):
            if opens:
                depth[tag] += 1
            elif depth[tag]:
                depth[tag] -= 1
                if tag == own and not depth[tag]:
                    return j
            else:
                if around is None:
                    around = Counter()
                    for _, opened, outer in tags(range(begin, i)):
                        around[outer] = max(0, around[outer] + (1 if opened else -1))
                if around[tag]:
                    return j
        return last

    def _first_element(self, name: str) -> list[str | None]:
        starts = self._of_name(name, START)
        bounds = np.searchsorted(starts, self.tokens.first).tolist()
        out: list[str | None] = []
        for a, b in zip(bounds, bounds[1:]):
            if a == b:
                out.append(None)
                continue
            i = int(starts[a])
            out.append(self._joined(self._spans(k for k in range(i, self._element_end(i, name)) if self.is_text[k])))
        return out

    def title(self) -> list[str]:
        return [text or "" for text in self._first_element("title")]

    def heading(self) -> list[str | None]:
        return self._first_element("h1")

    def links(self) -> pa.Array:
        """Anchors with an address, in page order; their text in lower case."""
        t = self.tokens
        anchors = np.flatnonzero(t.code == _CODE["a"])
        starts = anchors[t.kind[anchors] == START]
        after = np.append(anchors, len(t.start))[np.searchsorted(anchors, starts, "right")]
        after = np.minimum(after, t.first[t.page[starts] + 1])
        # The text ends before a `<` that begins no tag.
        cut = _next(t.loose, t.stop[starts], t.offsets[t.page[starts] + 1]).tolist()
        texts = np.flatnonzero(self.is_text)
        low, high = np.searchsorted(texts, starts).tolist(), np.searchsorted(texts, after).tolist()
        texts = texts.tolist()
        hrefs, words, pages = [], [], []
        for i, page, a, b, end in zip(starts.tolist(), t.page[starts].tolist(), low, high, cut):
            found = _HREF.match(self.raw, self.start[i], self.stop[i])
            if found:
                hrefs.append(_attribute_text(found[1]))
                words.append(self._joined([(x, min(y, end)) for x, y in self._spans(texts[a:b]) if x < end]).lower())
                pages.append(page)
        offsets = np.searchsorted(np.array(pages, np.int64), np.arange(self.count + 1)).astype(np.int32)
        items = pa.StructArray.from_arrays([pa.array(hrefs, pa.string()), pa.array(words, pa.string())], ["href", "text"])
        return pa.ListArray.from_arrays(pa.array(offsets), items)

    def _lists(self, found: list[tuple[int, str]]) -> list[list[str]]:
        out: list[list[str]] = [[] for _ in range(self.count)]
        for i, value in found:
            out[self.tokens.page[i]].append(value)
        return out

    def data_blocks(self) -> list[list[str]]:
        found = []
        for i in self._of_name("script", START).tolist():
            kind = _TYPE.match(self.raw, self.start[i], self.stop[i])
            if kind and _attribute_text(kind[1]).split(";")[0].strip().lower() == "application/ld+json":
                found.append((i, self.raw[self.stop[i] : self.gap_end[i]].decode("utf-8", "replace")))
        return self._lists(found)

    def locations(self) -> list[list[str]]:
        """The text of a loc element up to the next tag, past comments and marks."""
        t, found = self.tokens, []
        for i in self._of_name("loc", START).tolist():
            last = i + 1
            while last < t.first[t.page[i] + 1] and t.kind[last] == OTHER:
                last += 1
            found.append((i, self._joined(self._spans(k for k in range(i, last) if self.is_text[k]))))
        return self._lists([(i, text) for i, text in found if text])


def read_parts(html: pa.Array, names: tuple[str, ...], types: list[pa.DataType]) -> pa.StructArray:
    """The named parts of every page, some pages at a time."""
    if isinstance(html, pa.ChunkedArray):
        html = html.combine_chunks()
    known = html.is_valid().to_numpy(zero_copy_only=False)
    texts = html.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    columns: list[list[pa.Array]] = [[] for _ in names]
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1
        last = min(max(last, first + 1), len(texts))
        pages = Pages(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        for column, name, kind in zip(columns, names, types):
            value = getattr(pages, name)()
            column.append(value if isinstance(value, pa.Array) else pa.array(value, kind))
        first = last
    arrays = [pa.concat_arrays(c) if c else pa.array([], kind) for c, kind in zip(columns, types)]
    return pa.StructArray.from_arrays(arrays, list(names), mask=pa.array(~known))


_ARROW = {
    "string": pa.string(),
    "array<string>": pa.list_(pa.string()),
    "array<struct<href:string,text:string>>": pa.list_(pa.struct([("href", pa.string()), ("text", pa.string())])),
}


def page_parts(html: Column, *names: str) -> Column:
    """A struct of the named parts (see `PARTS`), out of one pass over the page."""
    types = [_ARROW[PARTS[name]] for name in names]

    def run(html: pa.Array) -> pa.Array:
        parts = read_parts(html, names, types)
        if html.nbytes > GIVE_BACK_BYTES:
            give_back()
        return parts

    return F.arrow_udf(run, f"struct<{','.join(f'{name}:{PARTS[name]}' for name in names)}>")(html)
