"""Visible text of web pages, laid out: blocks apart, lists marked, table cells aligned.

A tree builder keeps the path of open elements, with the tags that HTML lets authors leave out
(``<li>`` ends an open item, a block ends a paragraph, a row opens its table body, and so on), and
decides what is visible. A layout takes its events: it collapses white space, keeps margins
between blocks, marks and indents list items, keeps ``pre`` as it is, and lays out each table
on its own when it closes, with columns as wide as their widest cell.

Path and layout are explicit stacks, and open elements are found by tag: depth of nesting costs memory only, and each
page is read once, whatever it holds. A tag or comment that never closes reaches to the end, as in browsers. Output stays in proportion: indents end at
``INDENT`` columns, tables at ``NESTED`` levels (deeper ones are blocks), and cells of tables that are wider than ``WIDEST`` or beyond
``COLUMNS`` columns stand side by side without alignment. No text is left out by this.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from swarmtide.llm.text import extended, mapped, slices

#: Comments, tags (name, then attributes; only a value's quotes hide a ">") and declarations. Every part is possessive.
TOKEN = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+("[^"]*+"?|'[^']*+'?|[^\s>]*+))?+""", re.S)
SPAN = re.compile(r"\s*[0-9]{1,9}\s*")
#: Numbers that no character has.
HUGE = re.compile(r"&#[xX]?[0-9a-fA-F]{1000,}+;?")
HIDDEN_STYLE = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style title template iframe noembed noframes datalist object audio video canvas svg math".split())
INDENT = 80
NESTED = 16
COLUMNS = 100
WIDEST = 1000
IN_TABLES = frozenset("table caption colgroup col tbody thead tfoot tr td th".split())
#: Blank lines around a block.
BLOCK = dict.fromkeys("address article aside body center dd details dialog div dt fieldset figcaption footer form header hgroup html legend main nav option optgroup search section select summary tbody thead tfoot tr".split(), 0)
BLOCK |= dict.fromkeys("blockquote dl figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul xmp".split(), 1)
LISTS = frozenset(("ul", "ol", "menu"))
#: An opening tag ends the open elements named first, up to the nearest of those named second.
IMPLIED_END = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "tr": (("tr", "td", "th", "caption", "colgroup"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "caption": ((), ("table",)),
    "colgroup": (("caption",), ("table",)),
    "body": (("head",), ("html",)),
}
IMPLIED_END |= {"thead": IMPLIED_END["tbody"], "tfoot": IMPLIED_END["tbody"]}
#: No end tag reaches out of these, but their own and their table's.
WALLS = frozenset("table td th caption template object button".split())


class Sheet:
    """Lines of text in the making."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = self.margin = 0
        self.indent, self.mark = "", ""
        self.wants_space = False

    def text(self, s: str) -> None:
        words = s.split()
        if not words:
            self.wants_space |= bool(s and self.line)
            return
        if self.line and (self.wants_space or s[0].isspace()):
            self.line.append(" ")
        self.line.append(" ".join(words))
        self.wants_space = s[-1].isspace()

    def _put(self, s: str) -> None:
        if self.lines:
            self.lines += [""] * self.margin
        self.margin = 0
        self.lines.append((self.indent[: len(self.indent) - len(self.mark)] + self.mark + s) if self.mark else (self.indent + s if s else ""))
        self.mark = ""

    def end_line(self) -> None:
        if self.line:
            self._put("".join(self.line))
            self.line = []
        self.wants_space = False

    def block(self, margin: int) -> None:
        self.end_line()
        self.margin = max(self.margin, margin)

    def whole(self, lines: list[str]) -> None:
        for s in lines:
            self._put(s)


class Table:
    def __init__(self) -> None:
        self.rows: list[list[tuple[int, int, Sheet]]] = []  # columns and rows that a cell takes
        self.caption: Sheet | None = None

    def placed(self) -> list[list[tuple[int, int, list[str]]]]:
        """(column, columns, lines) of each row's cells; cells that reach down from rows above keep their columns."""
        free: dict[int, int] = {}  # the row from which on a column is free
        out = []
        for r, row in enumerate(self.rows):
            k, cells = 0, []
            for span, down, cell in row:
                while k < COLUMNS and free.get(k, 0) > r:
                    k += 1
                cells.append((k, span, cell.lines))
                if down > 1:
                    free |= dict.fromkeys(range(k, min(k + span, COLUMNS)), r + down)
                k += span
            out.append(cells)
        return out

    def lines(self) -> list[str]:
        """Cells side by side, two blanks between columns; a cell over several columns doesn't widen them."""
        rows = self.placed()
        widths = [-2] * COLUMNS  # of columns that no cell has to itself
        for row in rows:
            for k, span, lines in row:
                if span == 1 and k < COLUMNS:
                    widths[k] = max([widths[k], 0, *map(len, lines)])
        begins = [0, *accumulate(w + 2 for w in widths)]
        aligned = begins[-1] <= WIDEST
        out = list(self.caption.lines) if self.caption else []
        for cells in rows:
            depth = 0
            while cells := [c for c in cells if len(c[2]) > depth]:
                parts, size = [], 0
                for k, _, lines in cells:
                    if lines[depth]:
                        at = begins[min(k, COLUMNS)] if aligned else 0
                        gap = max(at - size, 2 if size else 0)
                        parts += [" " * gap, lines[depth]]
                        size += gap + len(lines[depth])
                out.append("".join(parts).rstrip())
                depth += 1
        return out


class Page:
    """Tree builder and layout of one page. Open elements: [tag, hidden, what the layout restores at its end]."""

    def __init__(self) -> None:
        self.path: list[tuple[str, bool, tuple | None]] = []
        self.places: dict[str, list[int]] = {}  # of open elements on the path
        self.sheet = Sheet()
        self.sheets: list[Sheet] = []
        self.tables: list[Table] = []
        self.numbers: list[int] = []

    def render(self, source: str) -> str:
        at, n = 0, len(source)
        while at < n:
            m = TOKEN.search(source, at)
            if m is None:
                self.text(source[at:])
                break
            if m.start() > at:
                self.text(source[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                self.close(tag)
            else:
                self.open(tag, m[3])
                if tag in RAW:
                    end = re.compile(rf"</{tag}(?=[\s/>])[^>]*+(?:>|\Z)", re.I).search(source, at)
                    inner, at = (source[at : end.start()], end.end()) if end else (source[at:], n)
                    if tag in ("textarea", "xmp"):
                        self.text(inner)
                    self.close(tag)
        while self.path:
            self.pop()
        self.sheet.end_line()
        return "\n".join(self.sheet.lines).strip("\n")

    def text(self, raw: str) -> None:
        if self.path and self.path[-1][1]:
            return
        s = html.unescape(HUGE.sub("\ufffd", raw)) if "&" in raw else raw
        if self.tables and self.path[-1][0] in ("table", "tbody", "thead", "tfoot", "tr", "colgroup") and s.strip():
            # text that strays among rows stands before the table
            self.sheets[-1].text(s)
        elif not self.tables or self.path[-1][0] not in ("table", "tbody", "thead", "tfoot", "tr", "colgroup"):
            if self.places.get("pre") or self.places.get("xmp"):
                for i, piece in enumerate(s.replace("\r\n", "\n").split("\n")):
                    if i:
                        self.sheet._put("".join(self.sheet.line))
                        self.sheet.line = []
                    if piece:
                        self.sheet.line.append(piece)
            else:
                self.sheet.text(s)

    def last(self, tags) -> int:
        """Place of the innermost open element of these tags, or -1."""
        return max((at[-1] for at in map(self.places.get, tags) if at), default=-1)

    def leave(self, size: int) -> None:
        while len(self.path) > size:
            self.pop()

    def open(self, tag: str, rest: str) -> None:
        if tag in IN_TABLES and len(self.tables) >= NESTED:
            tag = "div"
        if tag in IMPLIED_END:
            ends, walls = IMPLIED_END[tag]
            wall = self.last(walls)
            open_ = [at[k] for at in (self.places.get(x, ()) for x in ends) if (k := bisect_right(at, wall)) < len(at)]
            if open_:
                self.leave(min(open_))
        if tag in BLOCK and self.places.get("p"):
            self.close("p")
        if tag in ("td", "th") and self.tables and (not self.path or self.path[-1][0] != "tr"):
            self.open("tr", "")
        if tag in ("td", "th", "tr", "caption", "tbody", "thead", "tfoot", "col", "colgroup") and not self.tables:
            return
        hidden = bool(self.path and self.path[-1][1]) or tag in UNSEEN
        span = down = 1
        if not hidden and rest and not rest.isspace():
            named = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(rest)}
            hidden = "hidden" in named or bool(HIDDEN_STYLE.search(named.get("style", "")))
            hidden |= tag == "dialog" and "open" not in named
            if SPAN.fullmatch(named.get("colspan", "")):
                span = min(max(1, int(named["colspan"])), 1000)
            if SPAN.fullmatch(named.get("rowspan", "")):
                down = int(named["rowspan"]) or 65534  # 0: all rows that follow
        elif tag == "dialog":
            hidden = True
        if not hidden:
            # of closed details only the summary shows; the rest counts as visible text all the same
            if tag == "br":
                if self.sheet.line:
                    self.sheet.end_line()
                else:
                    self.sheet._put("")
            elif tag == "img" and rest:
                pass
            elif tag == "hr":
                self.sheet.block(1)
        if tag in VOID or (tag == "hr"):
            return
        undo = None
        if not hidden:
            if tag in BLOCK or tag in ("li", "caption"):
                nested = tag in LISTS and self.places.get("li")
                self.sheet.block(0 if nested else BLOCK.get(tag, 0))
            if tag in LISTS:
                start = re.search(r"start\s*=\s*[\"']?\s*(-?\d{1,9})", rest) if tag == "ol" else None
                self.numbers.append(int(start[1]) if start else 1)
            elif tag == "li":
                at = self.last(LISTS)
                ordered = at >= 0 and self.path[at][0] == "ol"
                mark = f"{self.numbers[-1]}. " if ordered and self.numbers else "- "
                if self.numbers:
                    self.numbers[-1] += 1
                undo = (self.sheet, self.sheet.indent)
                if len(self.sheet.indent) < INDENT:
                    self.sheet.indent += " " * len(mark)
                self.sheet.mark = mark
            elif tag in ("dd", "blockquote"):
                undo = (self.sheet, self.sheet.indent)
                if len(self.sheet.indent) < INDENT:
                    self.sheet.indent += "  "
            elif tag == "table":
                self.tables.append(Table())
                self.sheets.append(self.sheet)
                self.sheet = Sheet()
            elif tag == "tr":
                self.tables[-1].rows.append([])
            elif tag in ("td", "th"):
                self.sheet = Sheet()
                self.tables[-1].rows[-1].append((span, down, self.sheet))
            elif tag == "caption":
                self.sheet = self.tables[-1].caption = Sheet()
        self.places.setdefault(tag, []).append(len(self.path))
        self.path.append((tag, hidden, undo))

    def pop(self) -> None:
        tag, hidden, undo = self.path.pop()
        self.places[tag].pop()
        if hidden:
            return
        if undo:
            undo[0].end_line()
            undo[0].indent, undo[0].mark = undo[1], ""
        if tag in LISTS:
            self.numbers.pop()
        if tag in ("td", "th", "caption"):
            self.sheet.end_line()
            self.sheet = Sheet()
        elif tag == "table":
            table, self.sheet = self.tables.pop(), self.sheets.pop()
            self.sheet.end_line()
            self.sheet.whole(table.lines())
            self.sheet.block(1)
        elif tag in BLOCK or tag == "li":
            nested = tag in LISTS and self.places.get("li")
            self.sheet.block(0 if nested else BLOCK.get(tag, 0))

    def close(self, tag: str) -> None:
        if not self.places.get(tag):
            if tag == "p":
                self.sheet.block(1)
            elif tag == "br":
                self.open("br", "")
            return
        at = self.places[tag][-1]
        if self.last(WALLS) <= at or tag in ("table", "tr", "tbody", "thead", "tfoot", "html", "body"):
            self.leave(at)


def render(source: str | None) -> str:
    """Visible text of one page; null and empty pages give an empty text."""
    return Page().render(source) if source else ""


def extract(df: DataFrame, html_column: str = "html", into: str = "text") -> DataFrame:
    """Adds the visible text of each page as column ``into``, replacing a column of that name."""
    kept = [c for c in df.columns if c != into]
    at = kept.index(html_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                out = pa.array([render(x) for x in part.column(at).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, out], names=[*kept, into])

    return mapped(df, kept, run, extended(df, kept, f"`{into}` string"))
