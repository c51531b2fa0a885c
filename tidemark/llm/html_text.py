"""HTML extraction by layout-aware rendering.

A scanner splits the page into tags and text, a tree builder supplies the end
tags that HTML lets authors leave out and closes what an end tag leaves open,
and a renderer, fed as elements open and close, emits the visible text: blocks
on lines of their own with blank lines where browsers leave space, list items
with markers, table cells aligned in columns, preformatted text unchanged. The
builder keeps the open elements only, so deep pages need no recursion.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import ship, small_batches
from tidemark.llm.text import whole

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*)(?:>|\Z)|<|[^<]+", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACES = re.compile(r"[ \t\n\r\f]+")
NOT_DISPLAYED = re.compile(r"display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
RAW_WITH_REFERENCES = frozenset("textarea title".split())
NEVER_SHOWN = frozenset("head title script style template noscript noembed noframes iframe object audio video canvas svg math datalist select area base link meta param source track".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure fieldset hr".split())
BLOCK = SPACED | frozenset("html body address article aside center details dialog dd div dir dt figcaption footer form header hgroup legend li main menu nav optgroup option search section summary caption tr thead tbody tfoot".split())
ENDS_PARAGRAPH = (SPACED | frozenset("address article aside center details dialog dir div figcaption footer form header hgroup main menu nav search section".split())) | frozenset(("li", "dd", "dt"))
#: A start tag, the open elements that it ends, and the elements behind which it does not look for them.
IMPLIED_ENDS = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu", "dir", "table", "td", "th"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl", "table", "td", "th"))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl", "table", "td", "th"))),
    "td": (frozenset(("td", "th", "caption")), frozenset(("table", "tr"))),
    "th": (frozenset(("td", "th", "caption")), frozenset(("table", "tr"))),
    "tr": (frozenset(("tr", "td", "th", "caption", "colgroup")), frozenset(("table", "thead", "tbody", "tfoot"))),
    "thead": (frozenset(("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup")), frozenset(("table",))),
    "tbody": (frozenset(("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup")), frozenset(("table",))),
    "tfoot": (frozenset(("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup")), frozenset(("table",))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist", "optgroup"))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
}
#: An end tag does not close elements beyond these, unless it names them.
SCOPE = frozenset(("table", "td", "th", "caption", "html", "template"))
CLOSES_SCOPES = frozenset(("table", "tr", "thead", "tbody", "tfoot", "td", "th", "body", "html"))
#: A column is as wide as its longest cell up to this; longer cells push their row's rest to the right, so padding stays in proportion to the text.
COLUMN = 40
#: The standard's bounds of colspan and rowspan.
MOST_COLUMNS, MOST_ROWS = 1000, 65534


class _Box:
    """Lines of one flow of text: the page's or a table cell's."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0  # line breaks owed before the next text: 1 a new line, 2 a blank line too
        self.space = False
        self.lead = ""

    def add(self, text: str, pre: bool, indent: str) -> None:
        if pre:
            first, *rest = text.split("\n")
            if first:
                self._put(first, indent)
            for line in rest:
                self.end_line()
                if line:
                    self._put(line, indent)
            return
        words = SPACES.sub(" ", text)
        if words == " ":
            self.space = True
            return
        if words[:1] == " ":
            self.space, words = True, words[1:]
        trailing = words[-1:] == " "
        if words:
            self._put(words[:-1] if trailing else words, indent)
        self.space = trailing or self.space and not words

    def _put(self, text: str, indent: str) -> None:
        if self.gap:
            self.settle()
        if not self.line:
            self.line.append(indent[: len(indent) - len(self.lead)] + self.lead if self.lead else indent)
            self.lead = ""
        elif self.space:
            self.line.append(" ")
        self.line.append(text)
        self.space = False

    def settle(self) -> None:
        if self.line:
            self.end_line()
        if self.gap == 2 and self.lines and self.lines[-1]:
            self.lines.append("")
        self.gap = 0

    def end_line(self) -> None:
        self.lines.append("".join(self.line).rstrip())
        self.line, self.space = [], False

    def break_line(self) -> None:
        if self.gap:
            self.settle()
        self.end_line()

    def block(self, gap: int) -> None:
        if self.line or self.lines:
            self.gap = max(self.gap, gap)
        self.space = False

    def text(self) -> str:
        if self.line:
            self.end_line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return "\n".join(self.lines)


def _width(text: str) -> int:
    """Columns that a text takes: two for wide characters, none for combining ones."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class _Table:
    def __init__(self) -> None:
        self.rows: list[list[str]] = []
        self.taken: dict[int, int] = {}  # columns that cells of earlier rows reach into, and for how many rows yet
        self.coming: dict[int, int] = {}

    def row(self) -> None:
        self.taken = {c: n - 1 for c, n in self.taken.items() if n > 1} | self.coming
        self.coming = {}
        self.rows.append([])

    def cell(self, text: str, columns: int, rows: int) -> None:
        if not self.rows:
            self.row()
        row = self.rows[-1]
        while len(row) in self.taken:
            row.append("")
        if rows > 1:
            self.coming |= dict.fromkeys(range(len(row), len(row) + columns), rows - 1)
        row += [SPACES.sub(" ", text).strip(), *[""] * (columns - 1)]

    def lines(self) -> list[str]:
        rows = [r for r in self.rows if any(r)]
        widths = [0] * max(map(len, rows), default=0)
        for row in rows:
            for i, cell in enumerate(row):
                widths[i] = max(widths[i], min(COLUMN, _width(cell)))
        return ["  ".join(cell + " " * (w - _width(cell)) for cell, w in zip(row, widths, strict=False)).rstrip() for row in rows]


class _Renderer:
    """Takes elements as they open and close, and text between them."""

    def __init__(self) -> None:
        self.boxes = [_Box()]
        self.tables: list[_Table] = []
        self.lists: list[list] = []  # [ordered, next number]
        self.indents = [""]
        self.hidden = 0
        self.seen = True  # by visibility, which inner elements can turn on again
        self.pre = 0
        self.first_break = False  # a line break that follows <pre> at once is none

    def open(self, name: str, attributes: str) -> dict:
        """What close() needs to undo the element."""
        state = {"name": name, "hides": self._hides(name, attributes), "seen": self.seen}
        self.first_break = False
        self.hidden += state["hides"]
        if "visibility" in attributes.lower() and (said := VISIBILITY.findall(_attributes(attributes).get("style", ""))):
            self.seen = said[-1].lower() == "visible"
        if self.hidden:
            return state
        box = self.boxes[-1]
        if name == "br":
            box.break_line()
        elif name in BLOCK:
            box.block(2 if name in SPACED and not (name in ("ul", "ol") and self.lists) else 1)
        if name in ("ul", "ol", "menu", "dir"):
            start = _attributes(attributes).get("start", "") if name == "ol" and "start" in attributes.lower() else ""
            self.lists.append([name == "ol", int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
            state["list"] = True
        elif name == "li":
            marker = "- "
            if self.lists and self.lists[-1][0]:
                marker = f"{self.lists[-1][1]}. "
                self.lists[-1][1] += 1
            if box.line:
                box.gap = max(box.gap, 1)
            if box.gap:
                box.settle()
            # Nesting beyond 40 columns is not indented further, so that deep lists stay in proportion to their text.
            base = self.indents[-1]
            self.indents.append(base + " " * len(marker) if len(base) < 40 else base[: len(base) - len(marker)] + " " * len(marker))
            box.lead = marker
            state["indent"] = True
        elif name in ("dd", "blockquote"):
            self.indents.append(self.indents[-1] + "    " if len(self.indents[-1]) < 40 else self.indents[-1])
            state["indent"] = True
        elif name in ("pre", "textarea", "xmp"):
            self.pre += 1
            self.first_break = name != "xmp"
            state["pre"] = True
        elif name == "table":
            self.tables.append(_Table())
            state["table"] = True
        elif name == "tr" and self.tables:
            self.tables[-1].row()
        elif name in ("td", "th") and self.tables:
            found = _attributes(attributes) if "span" in attributes.lower() else {}
            columns, rows = found.get("colspan", ""), found.get("rowspan", "")
            state["cell"] = min(MOST_COLUMNS, int(columns)) if re.fullmatch(r"[1-9]\d{0,8}", columns) else 1, MOST_ROWS if rows == "0" else min(MOST_ROWS, int(rows)) if re.fullmatch(r"[1-9]\d{0,8}", rows) else 1
            self.boxes.append(_Box())
            state["saved"] = self.indents, self.lists
            self.indents, self.lists = [""], []
        return state

    @staticmethod
    def _hides(name: str, attributes: str) -> bool:
        if name in NEVER_SHOWN:
            return True
        if not attributes:
            return False
        low = attributes.lower()
        if "hidden" not in low and "display" not in low and name != "dialog":
            return False
        found = _attributes(attributes)
        return "hidden" in found or bool(NOT_DISPLAYED.search(found.get("style", ""))) or name == "input" and found.get("type", "").lower() == "hidden" or name == "dialog" and "open" not in found

    def text(self, text: str) -> None:
        if self.first_break and text.startswith("\n"):
            text = text[1:]
        self.first_break = False
        if not self.hidden and self.seen and text:
            self.boxes[-1].add(text, self.pre > 0, self.indents[-1])

    def close(self, state: dict) -> None:
        self.seen, self.first_break = state["seen"], False
        if self.hidden:
            self.hidden -= state["hides"]
            return
        name = state["name"]
        if "cell" in state:
            self.indents, self.lists = state["saved"]
            self.tables[-1].cell(self.boxes.pop().text(), *state["cell"])
            return
        box = self.boxes[-1]
        if "table" in state:
            for line in self.tables.pop().lines():
                if box.line:
                    box.gap = max(box.gap, 1)
                box.add(line, True, self.indents[-1])
                box.end_line()
        if "list" in state:
            self.lists.pop()
        if "pre" in state:
            self.pre -= 1
        if "indent" in state:
            self.indents.pop()
            box.lead = ""
        if name in BLOCK:
            box.block(2 if name in SPACED and not (name in ("ul", "ol") and self.lists) else 1)


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), unescape(next(filter(None, values), "")))
    return out


def _raw_end(html: str, name: str, at: int) -> int:
    found = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.I).search(html, at)
    return found.start() if found else len(html)


def render(html: str) -> str:
    """All visible text of a page, laid out; "" for an empty page."""
    renderer, opened, at = _Renderer(), [], 0
    where: dict[str, list[int]] = {}  # places of the open elements of a name, in order
    scopes: list[int] = []  # and of those of SCOPE

    def close_to(n: int) -> None:
        while len(opened) > n:
            state = opened.pop()
            where[state["name"]].pop()
            if scopes and scopes[-1] == len(opened):
                scopes.pop()
            renderer.close(state)

    def last(names) -> int:
        """The place of the innermost open element of these names, or -1."""
        return max((where[n][-1] for n in names if where.get(n)), default=-1)

    while at < len(html):
        token = TOKEN.match(html, at)
        at = token.end()
        slash, name, attributes = token.group(1, 2, 3)
        if name is None:
            if token[0][:1] != "<" or token[0] == "<":
                renderer.text(unescape(token[0]).replace("\r\n", "\n"))
            continue
        name = name.lower()
        if slash:
            if name == "p" and not where.get("p"):
                renderer.close(renderer.open("p", ""))
            elif name == "br":
                renderer.open("br", "")
            elif where.get(name) and (where[name][-1] >= (scopes[-1] if scopes else -1) or name in CLOSES_SCOPES):
                close_to(where[name][-1])
            continue
        if name in ENDS_PARAGRAPH and where.get("p") and where["p"][-1] > max(scopes[-1] if scopes else -1, last(("button",))):
            close_to(where["p"][-1])
        if name in IMPLIED_ENDS:
            ends, stops = IMPLIED_ENDS[name]
            stop = last(stops)
            ended = [where[n][k] for n in ends if where.get(n) and (k := bisect_right(where[n], stop)) < len(where[n])]
            if ended:
                close_to(min(ended))
        elif name == "body" and where.get("head") or name not in NEVER_SHOWN and where.get("head") and opened and opened[-1]["name"] == "head":
            close_to(where["head"][0])
        state = renderer.open(name, attributes)
        if name in VOID:
            renderer.close(state)
        elif name in RAW or name in RAW_WITH_REFERENCES:
            end = _raw_end(html, name, at)
            renderer.text(unescape(html[at:end]) if name in RAW_WITH_REFERENCES else html[at:end])
            renderer.close(state)
            closing = html.find(">", end)
            at = len(html) if closing < 0 else closing + 1
        elif attributes.rstrip().endswith("/") and name in ("svg", "math"):
            renderer.close(state)
        else:
            if name in SCOPE:
                scopes.append(len(opened))
            where.setdefault(name, []).append(len(opened))
            opened.append(state)
    close_to(0)
    return renderer.boxes[0].text()


def extract(pages: DataFrame, html_col: str = "html", to: str = "text") -> DataFrame:
    """``pages`` with the column ``to``: the page's visible text.

    A null or empty page gives an empty text; repeated rows each get theirs. A
    column named ``to`` is replaced, all others stay. Whole pages are rendered,
    broken ones too: unclosed elements end with the page, stray end tags are
    ignored.
    """
    ship(pages.sparkSession)
    small_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def rendered(html: pd.Series) -> pd.Series:
        return html.map(render)

    return pages.withColumn(to, rendered(whole(F.col(html_col))))
