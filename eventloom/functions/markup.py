"""A page as one text and a flat list of its elements, from one pass with a stack; its scripts apart.

An element is its tag, the attributes that parsers ask for, the ranges of the page's text and of its source that it holds,
the place of its last descendant, and the places of the table row and of the list item around it. So its text, its markup
and the markup around it are slices, and what it holds is a slice of the list; no parser looks for where an element ends.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .steps import in_steps
from .text import squeezed

_KINDS = {**dict.fromkeys(("at", "last"), T.IntegerType()), **dict.fromkeys(("tag", "href", "cls", "id", "label"), T.StringType()), **dict.fromkeys(("a", "b", "start", "end", "link", "row", "item"), T.IntegerType()), **dict.fromkeys(("main", "aside"), T.BooleanType())}
PAGE = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("scripts", T.ArrayType(T.StructType([T.StructField(k, T.StringType()) for k in ("type", "text")]))),
    T.StructField("elements", T.ArrayType(T.StructType([T.StructField(k, kind) for k, kind in _KINDS.items()]))),
])
# Tags and class words of list items, class words of what holds several, tags and class words of side content.
ITEM_TAGS, ITEM_WORDS = frozenset("section article div li".split()), frozenset("race event post card".split())
HOLDERS = ("list", "board", "container", "wrap", "grid")
ASIDE_TAGS, ASIDE_WORDS = frozenset("template nav footer".split()), ("related", "recommend")
ASIDE_BLOCKS = frozenset("aside section div".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style".split())
#: Elements after which the text goes on in a new line.
LINES = frozenset("p div li tr td th dt dd section article header footer main h1 h2 h3 h4 h5 h6 table ul ol br".split())


def names_item(tag: str, cls: str) -> bool:
    """Whether an element's class names one entry of a list."""
    low = cls.lower()
    return tag in ITEM_TAGS and not ITEM_WORDS.isdisjoint(re.split(r"[\s_-]+", low)) and not any(h in low for h in HOLDERS)


class _Page(HTMLParser):
    def __init__(self, source: str) -> None:
        super().__init__(convert_charrefs=True)
        self.chunks, self.size, self.scripts, self.elements, self.open = [], 0, [], [], []
        self.source, self.line_starts = source, [0, *(m.end() for m in re.finditer("\n", source))]

    def _place(self) -> int:
        """Where in the source the tag that is read begins."""
        line, column = self.getpos()
        return self.line_starts[line - 1] + column

    def _write(self, data: str) -> None:
        self.chunks.append(data)
        self.size += len(data)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        own = {k: v or "" for k, v in reversed(attrs)}
        start, written = self._place(), self.get_starttag_text() or ""
        link = re.search(r"(?i)\bhref\s*=", written) if "href" in own else None
        cls, at = own.get("class", ""), len(self.elements)
        above = self.elements[self.open[-1]] if self.open else {"row": None, "item": None, "main": False, "aside": False}
        if tag in LINES:
            self._write("\n")
        label = next((own[k].strip() for k in ("aria-label", "title", "alt") if own.get(k, "").strip()), None)
        element = {
            "at": at, "last": at, "tag": tag, "href": own.get("href"), "cls": cls, "id": own.get("id"), "label": label, "a": self.size, "b": self.size,
            "start": start, "end": start + len(written), "link": start + link.start() if link else None,
            "row": at if tag == "tr" else above["row"], "item": at if names_item(tag, cls) else above["item"], "main": above["main"] or tag == "main",
            "aside": above["aside"] or tag in ASIDE_TAGS or tag in ASIDE_BLOCKS and any(w in cls.lower() for w in ASIDE_WORDS),
        }
        self.elements.append(element)
        if tag in SILENT:
            self.scripts.append({"type": own.get("type"), "text": ""})
        if tag not in VOID:
            self.open.append(at)

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self.open) - 1, -1, -1):
            if self.elements[self.open[depth]]["tag"] == tag:
                start = self._place()
                for at in self.open[depth + 1 :]:
                    self._end(at, start)
                self._end(self.open[depth], self.source.find(">", start) + 1 or len(self.source))
                del self.open[depth:]
                break
        if tag in LINES:
            self._write("\n")

    def _end(self, at: int, end: int) -> None:
        self.elements[at].update(last=len(self.elements) - 1, b=self.size, end=end)

    def handle_data(self, data: str) -> None:
        if self.open and self.elements[self.open[-1]]["tag"] in SILENT:
            self.scripts[-1]["text"] += data
        else:
            self._write(data)

    def close(self) -> None:
        super().close()
        for at in self.open:
            self._end(at, len(self.source))


def page_of(source: str | None) -> dict:
    """The page of a source; of null, one without elements."""
    p = _Page(source or "")
    p.feed(p.source)
    p.close()
    return {"text": "".join(p.chunks), "scripts": p.scripts, "elements": p.elements}


@F.arrow_udf(PAGE)
def page(source: pa.Array) -> pa.Array:
    return in_steps(source, page_of, PAGE)


#: Not to be copied into every place that uses its result: each page is parsed once.
page = page.asNondeterministic()


def lines(p: Column, element: Column) -> Column:
    """An element's text, blocks in lines of their own."""
    return F.substr(p["text"], element["a"] + 1, element["b"] - element["a"])


def shown(p: Column, element: Column) -> Column:
    """An element's text, white space squeezed."""
    return squeezed(lines(p, element))


def written(html: Column, element: Column) -> Column:
    """An element's markup, from its start tag to its end tag, or to where another one's ends it."""
    return F.substr(html, element["start"] + 1, element["end"] - element["start"])


def around(html: Column, place: Column, radius: int) -> Column:
    """So many characters of markup before a place in the source and from it on."""
    start = F.greatest(place - radius, F.lit(0))
    return F.substr(html, start + 1, place + radius - start)


def inside(p: Column, element: Column) -> Column:
    """The elements that one holds, in order."""
    return F.slice(p["elements"], element["at"] + 2, element["last"] - element["at"])


def has_word(element: Column, *words: str) -> Column:
    """Whether one of the class names is, or has as a part, one of the words."""
    return F.coalesce(element["cls"], F.lit("")).rlike(rf"(?i)\b(?:{'|'.join(words)})\b")


def first(elements: Column, ok) -> Column:
    return F.get(F.filter(elements, ok), F.lit(0))
