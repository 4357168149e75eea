"""HTML extraction by layout-aware rendering.

A page is tokenised once; a stack of open elements with implied ends stands for
the tree, and text is rendered as it is met. An open head ends at the first tag or
text that cannot stand in it. Elements that never show (scripts,
styles, ``hidden``, ``display:none``) swallow their text. Blocks start on a new
line with blank lines between paragraphs, list items get a bullet or number and
an indent by depth, preformatted text keeps its white space, and the cells of a
table are padded to columns. Memory holds one page and its open tables.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from itertools import zip_longest

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import spread, tune

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)", re.S)
#: The rest of a tag: quoted values may hold its end. Where a quote never closes, that tag and all after it end at the next ">".
REST = re.compile(r"((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
LOOSE_REST = re.compile(r"([^>]*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
#: A last slash that belongs to an unquoted value, so it does not close the element.
UNQUOTED_END = re.compile(r"=\s*[^\s\"'>]*/\Z")
INVISIBLE_STYLE = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER_SHOWN = frozenset("head script style template noscript title iframe desc metadata defs annotation annotation-xml datalist audio video canvas".split())
FOREIGN = frozenset("svg math".split())
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
RAW = frozenset("script style title textarea iframe noscript".split())
BLOCK = frozenset("address article aside body details dialog dd div dl dt fieldset figcaption figure footer form header hgroup html legend li main nav ol optgroup option section summary table ul".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre hr".split())
ENDS_PARAGRAPH = (BLOCK | SPACED) - {"html", "body", "optgroup", "option"}
#: An opening tag ends these open elements, up to the element that bounds the search.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}),
}


#: Parts of tables, which alone may end a cell or table from inside it, and the elements that keep other end tags in.
TABLE_PARTS = frozenset("table caption thead tbody tfoot tr td th".split())


class Sheet:
    """Rendered lines under construction: pending breaks collapse, white space collapses outside ``pre``."""

    def __init__(self):
        self.parts: list[str] = []
        self.breaks, self.space, self.empty = 0, False, True

    def need(self, breaks: int) -> None:
        if not self.empty:
            self.breaks = max(self.breaks, breaks)
        self.space = False

    def raw(self, text: str) -> None:
        if text:
            self.parts.append("\n" * self.breaks + (" " if self.space and not self.breaks else "") + text)
            self.breaks, self.space, self.empty = 0, False, False

    def flow(self, text: str) -> None:
        words = text.split()
        if not words:
            self.space = self.space or (bool(text) and not self.empty)
            return
        self.space = (self.space or text[0].isspace()) and not self.empty
        self.raw(" ".join(words))
        self.space = text[-1].isspace()

    def text(self) -> str:
        return "".join(self.parts)


class Renderer:
    def __init__(self):
        self.stack: list[tuple[str, bool]] = []  # element, whether it hides its content
        self.hidden = 0
        self.sheets = [Sheet()]
        self.lists: list[int | None] = []  # next number, or None for bullets
        self.tables: list[list[list[list[str]]]] = []  # rows of cells of lines
        self.pre = 0

    def write(self, text: str) -> None:
        if self.hidden and self.stack[-1][0] == "head" and not text.isspace() and text:
            self._pop()
        if self.hidden or not text:
            return
        shown = unescape(text) if "&" in text else text
        self.sheets[-1].raw(shown) if self.pre else self.sheets[-1].flow(shown)

    def start(self, tag: str, attributes: str) -> bool:
        """Open an element; whether it has content."""
        if self.stack and self.stack[-1][0] == "head" and tag not in IN_HEAD:
            self._pop()
        if tag == "head" and any(t != "html" for t, _ in self.stack):
            return False
        if attributes.endswith("/") and (tag in FOREIGN or any(t in FOREIGN for t, _ in self.stack)) and not UNQUOTED_END.search(attributes):
            return False
        if tag in IMPLIED:
            self._imply(*IMPLIED[tag])
        elif tag in ENDS_PARAGRAPH and any(t == "p" for t, _ in self.stack):
            self._imply({"p"}, {"td", "th", "table", "button"})
        if tag == "br":
            if not self.hidden:
                self.sheets[-1].breaks += not self.sheets[-1].empty
                self.sheets[-1].space = False
            return False
        hides = tag in NEVER_SHOWN or self._hides(attributes)
        if tag in VOID:
            if tag == "hr" and not self.hidden and not hides:
                self.sheets[-1].need(2)
            elif tag == "img" and not self.hidden and not hides:
                alt = next((v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes) if k.lower() == "alt"), "")
                self.write(alt)
            return False
        self.stack.append((tag, hides))
        self.hidden += hides
        if self.hidden:
            return True
        sheet = self.sheets[-1]
        if tag in SPACED:
            sheet.need(2)
        elif tag in BLOCK:
            sheet.need(1)
        if tag in ("ul", "ol"):
            self.lists.append(1 if tag == "ol" else None)
        elif tag == "li":
            number = self.lists[-1] if self.lists else None
            if number is not None:
                self.lists[-1] = number + 1
            sheet.raw("  " * max(len(self.lists) - 1, 0) + (f"{number}. " if number is not None else "- "))
        elif tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables:
            self.sheets.append(Sheet())
        self.pre += tag == "pre"
        return True

    def end(self, tag: str) -> None:
        within = frozenset({"table"}) if tag in TABLE_PARTS else TABLE_PARTS
        place = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == tag or self.stack[i][0] in within), -1)
        if place >= 0 and self.stack[place][0] == tag:
            while len(self.stack) > place:
                self._pop()
        elif tag in ("p", "br") and not self.hidden:
            self.sheets[-1].need(2 if tag == "p" else 1)

    def _imply(self, ends: set[str], bound: set[str]) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in bound:
                return
            if self.stack[i][0] in ends:
                while len(self.stack) > i:
                    self._pop()
                # a cell inside a row: go on outward until the bound
                return self._imply(ends, bound)

    def _pop(self) -> str:
        tag, hides = self.stack.pop()
        shown = not self.hidden
        self.hidden -= hides
        if not shown:
            return tag
        self.pre -= tag == "pre"
        if tag in ("td", "th") and self.tables and len(self.sheets) > 1:
            cell = self.sheets.pop().text()
            rows = self.tables[-1]
            if not rows:
                rows.append([])
            rows[-1].append([line.rstrip() for line in cell.split("\n") if line.strip()])
        elif tag == "table" and self.tables:
            rows = self.tables.pop()
            widths = [max((len(line) for r in rows if i < len(r) for line in r[i]), default=0) for i in range(max(map(len, rows), default=0))]
            for row in rows:
                for lines in zip_longest(*row, fillvalue="") if any(row) else [[""] * len(row)]:
                    self.sheets[-1].need(1)
                    self.sheets[-1].raw("  ".join(c.ljust(w) for c, w in zip(lines, widths)).rstrip())
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
        self.sheets[-1].need(2 if tag in SPACED else 1 if tag in BLOCK else 0) if tag in SPACED or tag in BLOCK else None
        return tag

    @staticmethod
    def _hides(attributes: str) -> bool:
        if not attributes.strip():
            return False
        found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)}
        return "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(INVISIBLE_STYLE.search(found.get("style", "")))

    def finish(self) -> str:
        while self.stack:
            self._pop()
        return self.sheets[0].text()


def render(html: str) -> str:
    """All visible text of a page; malformed markup never fails, an unclosed comment ends the page."""
    out, at, rest_of = Renderer(), 0, REST
    while True:
        m = TOKEN.search(html, at)
        if not m:
            out.write(html[at:])
            return out.finish()
        out.write(html[at : m.start()])
        at = m.end()
        if not m.group(2):
            continue
        rest = rest_of.match(html, at)
        if not rest:
            rest_of = LOOSE_REST
            rest = rest_of.match(html, at)
        if not rest:
            out.write(html[m.start() :])
            return out.finish()
        at = rest.end()
        tag = m.group(2).lower()
        if m.group(1):
            out.end(tag)
            continue
        if out.start(tag, rest.group(1)) and tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, at)
            out.write(html[at : close.start() if close else len(html)])
            at = close.end() if close else len(html)
            out.end(tag)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``page_id, text`` of every page: the rendered visible text.

    A null or empty page has an empty text; repeated rows repeat; a null key is kept; other columns are ignored.
    """
    tune(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([render(h) for h in batch.column(1).to_pylist()], pa.string())], names=["page_id", "text"])

    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    return spread(source).mapInArrow(run, "page_id long, text string")
