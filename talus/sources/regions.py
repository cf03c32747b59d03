"""Regions of a page: which elements each text stands in, whether tags are closed or not.

``regions`` reads a page once, in Arrow batches, with a stack of open tags, and gives its texts and its elements as arrays: an element covers the
texts ``first`` to ``last`` and the elements up to ``end`` (both exclusive). What is asked of a page afterwards (``select``, ``section``,
``text_without``) are column expressions on these arrays, so a page stays one row and nothing is shuffled.

Left-open tags end where the standard ends them: ``li``, ``p``, ``tr``, ``td``, ``th``, ``dt``, ``dd`` and ``option`` at the next of their kind or at
the block that cannot stand in them, others with their parent or the page. A closing tag without its opening one is skipped. Scripts and styles are texts
too, comments are not. A null page has no texts and no elements.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from talus.functions import text as T

ELEMENT = "tag string, id string, classes array<string>, href string, first int, last int, end int"
REGIONS = f"texts array<string>, elements array<struct<{', '.join(x.replace(' ', ':', 1) for x in ELEMENT.split(', '))}>>"

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCK = "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul"
#: tag -> (what it ends if it is still open, where the search for that stops)
_ENDS = {t: (frozenset(["p"]), frozenset(["table", "td", "th", "button"])) for t in _BLOCK.split()}
_ENDS |= {"li": (frozenset(["li", "p"]), frozenset(["ul", "ol", "menu", "table"])), "option": (frozenset(["option"]), frozenset(["select"]))}
_ENDS |= {t: (frozenset(["dt", "dd", "p"]), frozenset(["dl"])) for t in ("dt", "dd")}
_ENDS |= {t: (frozenset(["td", "th", "p"]), frozenset(["table"])) for t in ("td", "th")}
_ENDS |= {"tr": (frozenset(["tr", "td", "th", "p", "caption"]), frozenset(["table"]))}
_ENDS |= {t: (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "p", "caption"]), frozenset(["table"])) for t in ("thead", "tbody", "tfoot")}


class _Stack(HTMLParser):
    """Texts and elements of one page; ``open`` holds the numbers of the elements that are open."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.texts: list[str] = []
        self.elements: list[dict] = []
        self.open: list[int] = []

    def _close(self, depth: int) -> None:
        for n in self.open[depth:]:
            self.elements[n]["last"], self.elements[n]["end"] = len(self.texts), len(self.elements)
        del self.open[depth:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        ended, stops = _ENDS.get(tag, ((), ()))
        depth = None
        if ended:
            for d in range(len(self.open) - 1, -1, -1):
                name = self.elements[self.open[d]]["tag"]
                if name in stops:
                    break
                if name in ended:
                    depth = d
        if depth is not None:
            self._close(depth)
        held: dict[str, str | None] = {}
        for name, value in attrs:
            held.setdefault(name, value)  # the first of a name counts
        here = len(self.texts)
        self.open.append(len(self.elements))
        self.elements.append({"tag": tag, "id": held.get("id"), "classes": (held.get("class") or "").split(), "href": held.get("href"), "first": here, "last": here, "end": 0})
        if tag in _VOID:
            self._close(len(self.open) - 1)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash does not close what is not void

    def handle_endtag(self, tag: str) -> None:
        for d in range(len(self.open) - 1, -1, -1):
            if self.elements[self.open[d]]["tag"] == tag:
                self._close(d)
                return

    def handle_data(self, data: str) -> None:
        self.texts.append(data)


def read_regions(html: str | None) -> dict:
    """The texts and elements of one page."""
    stack = _Stack()
    stack.feed(html or "")
    stack.close()
    stack._close(0)
    return {"texts": stack.texts, "elements": stack.elements}


def _arrow_type() -> pa.DataType:
    kinds = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
    element = pa.struct([(n, kinds[k]) for n, k in (x.split(" ", 1) for x in ELEMENT.split(", "))])
    return pa.struct([("texts", pa.list_(pa.string())), ("elements", pa.list_(element))])


def regions(html: Column) -> Column:
    """A struct of the page's texts and elements."""

    def read(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = _arrow_type()
        for part in parts:
            yield pa.array([read_regions(x) for x in part.to_pylist()], kind)

    read.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(read, f"struct<{REGIONS.replace('texts array', 'texts:array').replace('elements array', 'elements:array')}>")(html)


_SIMPLE = re.compile(r"([A-Za-z][\w-]*)|\.([\w-]+)|#([\w-]+)|\[href\*=[\"']?([^\"'\]]+)[\"']?\]")


def _fits(e: Column, simple: str) -> Column:
    """Whether an element fits ``tag``, ``.class``, ``#id``, ``[href*=part]``, or several of them together."""
    out, at = F.lit(True), 0
    for m in _SIMPLE.finditer(simple):
        if m.start() != at:
            break
        at = m.end()
        tag, cls, id_, part = m.groups()
        out &= F.coalesce(e.tag == tag.lower() if tag else F.array_contains(e.classes, cls) if cls else e.id == id_ if id_ else F.contains(e.href, F.lit(part)), F.lit(False))
    if at != len(simple) or not simple:
        raise ValueError(f"cannot select {simple!r}")
    return out


def select(page: Column, path: str) -> Column:
    """The elements that fit the last part of ``path`` and stand, at any depth, in ones that fit the parts before it; in the page's order."""
    numbered = F.transform(page.elements, lambda e, n: F.struct(n.alias("n"), *[e[c.split()[0]].alias(c.split()[0]) for c in ELEMENT.split(", ")]))
    above = None
    for simple in path.split():
        if above is None:
            above = F.filter(numbered, lambda e: _fits(e, simple))
        else:
            outer = above
            above = F.filter(numbered, lambda e: _fits(e, simple) & F.exists(outer, lambda o: (o.n < e.n) & (e.n < o.end)))
    return above


def texts_of(page: Column, element: Column) -> Column:
    """The texts under an element."""
    return F.slice(page.texts, element.first + 1, element.last - element.first)


def text_of(page: Column, element: Column) -> Column:
    """All text under an element in one line."""
    return T.clean(F.array_join(texts_of(page, element), " "))


def section(page: Column, path: str) -> Column:
    """The texts of the elements at ``path``, a blank line between two; such as are empty or ``-`` are left out."""
    return F.array_join(F.filter(F.transform(select(page, path), lambda e: text_of(page, e)), lambda x: ~x.isin("", "-")), "\n\n")


def text_without(page: Column, inside: str, *excluded: str) -> Column:
    """The text of the first element at ``inside``, or of the whole page where there is none, without what stands in elements at ``excluded``."""
    root = F.get(select(page, inside), 0)
    first, last = F.coalesce(root.first, F.lit(0)), F.coalesce(root.last, F.size(page.texts))
    gone = F.concat(*[select(page, p) for p in excluded]) if excluded else F.array().cast("array<struct<first:int,last:int>>")
    kept = F.filter(page.texts, lambda _, i: (i >= first) & (i < last) & ~F.exists(gone, lambda e: (e.first <= i) & (i < e.last)))
    return T.clean(F.array_join(kept, " "))


def open_ids(page: Column) -> Column:
    """(pos, text, ids) of each text: the ids of the elements that it stands in, the outermost first."""
    marked = F.filter(page.elements, lambda e: e.id.isNotNull())
    return F.transform(page.texts, lambda x, i: F.struct(i.alias("pos"), x.alias("text"), F.transform(F.filter(marked, lambda e: (e.first <= i) & (i < e.last)), lambda e: e.id).alias("ids")))
