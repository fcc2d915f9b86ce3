"""Text of HTML pages as a browser would lay it out.

A tokenizer feeds a tree builder that supplies implied end tags (``p``, ``li``, ``dt``,
``dd``, ``option``, table parts) and implied rows of tables, ignores end tags that close nothing, and knows void
and raw-text elements. An element that its name, the ``hidden`` attribute or
``display:none`` takes away is gone with all it holds; inline ``visibility`` is
inherited, and what is inside may be visible again. The renderer collapses white space,
separates blocks by line breaks (paragraph-like ones by an empty line), marks list
items, keeps preformatted text, and aligns the cells of a table in columns, those that
span columns or rows as well. Nesting may be of any depth.
"""

from __future__ import annotations

import html
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAMES = lambda s: frozenset(s.split())
VOID = _NAMES("area base br col embed hr img input link meta param source track wbr")
RAW = _NAMES("script style textarea title xmp iframe noembed noframes")
UNSEEN = _NAMES("head script style template noscript iframe noembed noframes object audio video canvas svg datalist title meta link param source track area base")
BLOCK = _NAMES("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol optgroup option p pre search section summary table ul caption tr tbody thead tfoot td th")
#: Blocks with an empty line around them.
SPACED = _NAMES("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir blockquote pre table figure fieldset")
#: For a start tag: the open elements that it ends, and those at which the search for them stops.
_CELL = _NAMES("table template")
ENDS = {
    "li": (_NAMES("li"), _NAMES("ul ol menu dir table")),
    "dt": (_NAMES("dt dd"), _NAMES("dl table")),
    "dd": (_NAMES("dt dd"), _NAMES("dl table")),
    "option": (_NAMES("option"), _NAMES("select datalist")),
    "optgroup": (_NAMES("option optgroup"), _NAMES("select")),
    "td": (_NAMES("td th caption colgroup"), _NAMES("tr table")),
    "th": (_NAMES("td th caption colgroup"), _NAMES("tr table")),
    "tr": (_NAMES("td th tr caption colgroup"), _CELL),
    "tbody": (_NAMES("td th tr tbody thead tfoot caption colgroup"), _CELL),
    "thead": (_NAMES("td th tr tbody thead tfoot caption colgroup"), _CELL),
    "tfoot": (_NAMES("td th tr tbody thead tfoot caption colgroup"), _CELL),
    "body": (_NAMES("head"), _NAMES("html")),
}
#: For a start tag of a table part: the elements directly inside which it stands. What else is open within them ends, as its content is moved before the table.
_TABLE = _NAMES("table template html")
_GROUP = _TABLE | _NAMES("tbody thead tfoot")
WITHIN = {"td": _GROUP | {"tr"}, "th": _GROUP | {"tr"}, "tr": _GROUP, "tbody": _TABLE, "thead": _TABLE, "tfoot": _TABLE}
#: A form that opens directly inside these holds nothing.
ROWS = _NAMES("table tbody thead tfoot tr")
#: Start tags that end an open paragraph, and the elements that shelter it.
ENDS_P = (BLOCK | {"hr"}) - _NAMES("html body option optgroup caption tr tbody thead tfoot td th legend")
SHELTER = _NAMES("td th caption button object table html")
#: Elements that head may hold; any other content ends it.
IN_HEAD = _NAMES("base link meta title style script noscript template")
#: An end tag never reaches beyond these for an element inside.
FENCE = _NAMES("table td th caption html")

TOKEN = re.compile(r"<(?:!--(?:>|->|(?:.*?(?:--!?>|\Z)))|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)|[!?/][^>]*+(?:>|\Z))", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
GONE, VISIBILITY = re.compile(r"display\s*:\s*none", re.I), re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)
SPACE = re.compile(r"[ \t\n\f\r]+")
#: Elements whose attributes count beside ``hidden`` and ``style``.
NUMBERED = _NAMES("ol li td th")
#: The most columns and rows that a cell may span, as HTML has it.
MOST_COLUMNS, MOST_ROWS = 1000, 65534


class Node:
    """``start``: the first number of a list, or an item's own; ``shown``: None where visibility is inherited; ``span``: columns and rows of a cell."""

    __slots__ = ("children", "hidden", "name", "shown", "span", "start")

    def __init__(self, name: str, attributes: str = ""):
        self.name, self.children, self.hidden, self.start, self.shown, self.span = name, [], name in UNSEEN, None, None, (1, 1)
        if attributes and (name in NUMBERED or "hidden" in (low := attributes.lower()) or "style" in low):
            for m in ATTRIBUTE.finditer(attributes):
                key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if key == "hidden":
                    self.hidden = True
                elif key == "style":
                    style = html.unescape(value)
                    self.hidden |= bool(GONE.search(style))
                    for found in VISIBILITY.findall(style):
                        self.shown = found.lower() == "visible"
                elif re.fullmatch(r"\s*-?\d{1,9}\s*", value):
                    n = int(value)
                    if (name, key) in (("ol", "start"), ("li", "value")):
                        self.start = n
                    elif key == "colspan":
                        self.span = min(MOST_COLUMNS, max(1, n)), self.span[1]
                    elif key == "rowspan":
                        self.span = self.span[0], min(MOST_ROWS, n if n > 0 else MOST_ROWS)


def build(source: str) -> Node:
    """The element tree of a page; text is kept as strings between the elements."""
    root = Node("html")
    stack, at, size = [root], 0, len(source)
    places: dict[str, list[int]] = {"html": [0]}  # where in the stack the open elements of each name stand

    def push(node: Node) -> None:
        places.setdefault(node.name, []).append(len(stack))
        stack.append(node)

    def cut(i: int) -> None:
        while len(stack) > i:
            places[stack.pop().name].pop()

    def last(names: frozenset) -> int:
        return max((p[-1] for n in names if (p := places.get(n))), default=0)

    def close(names: frozenset, stop: frozenset) -> None:
        while (i := last(names)) > last(stop):
            cut(i)

    def text(piece: str) -> None:
        if piece:
            if stack[-1].name == "head" and not piece.isspace():
                cut(len(stack) - 1)
            stack[-1].children.append(html.unescape(piece) if "&" in piece else piece)

    while at < size:
        m = TOKEN.search(source, at)
        if not m:
            text(source[at:])
            break
        text(source[at : m.start()])
        at = m.end()
        if not (name := m[2]):
            continue
        name = name.lower()
        if m[1]:
            if name == "br":
                stack[-1].children.append(Node("br"))
            elif name == "p" and not places.get("p"):
                stack[-1].children.append(Node("p"))
            elif (i := last(frozenset([name]))) > 0 and (name in ENDS or name in FENCE or i > last(FENCE)):
                cut(i)
            continue
        if name == "html":
            continue
        if stack[-1].name == "head" and name not in IN_HEAD:
            cut(len(stack) - 1)
        if name in ENDS_P:
            close(_NAMES("p"), SHELTER)
        if name in ENDS:
            close(*ENDS[name])
        if name in WITHIN:
            if (i := last(WITHIN[name])) > 0:
                cut(i + 1)
            if name in ("td", "th") and stack[-1].name in _GROUP - {"html"}:  # the row that its start tag implies
                row = Node("tr")
                stack[-1].children.append(row)
                push(row)
        node = Node(name, m[3])
        stack[-1].children.append(node)
        if name in VOID or m[3].endswith("/") and name in ("svg", "path") or name == "form" and stack[-1].name in ROWS:
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(source, at)
            body = source[at : end.start()] if end else source[at:]
            if body and not node.hidden:
                node.children.append(html.unescape(body) if name == "textarea" else body)
            at = end.end() if end else size
        else:
            push(node)
    return root


class _Writer:
    """Lines of text; spaces and breaks wait until something visible follows."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.breaks, self.space, self.prefix = 0, False, ""

    def text(self, piece: str) -> None:
        parts = SPACE.sub(" ", piece)
        if parts in ("", " "):
            self.space |= bool(parts)
            return
        if self.space or parts[0] == " ":
            self._write(parts.strip(" "), True)
        else:
            self._write(parts.rstrip(" "), False)
        self.space = parts[-1] == " "

    def _write(self, piece: str, spaced: bool) -> None:
        if self.breaks:
            if self.out:
                self.out.append("\n" * self.breaks)
            spaced = False
        elif not self.out:
            spaced = False
        if self.prefix:
            self.out.append(self.prefix)
            self.prefix, spaced = "", False
        if spaced:
            self.out.append(" ")
        self.out.append(piece)
        self.breaks, self.space = 0, False

    def literal(self, piece: str) -> None:
        if piece:
            self._write(piece, self.space)

    def gap(self, lines: int) -> None:
        self.breaks, self.space = max(self.breaks, lines), False

    def more(self) -> None:
        self.breaks, self.space = min(self.breaks + 1, 2), False


def _render(node: Node, w: _Writer, depth: int, pre: bool, shown: bool) -> None:
    """Write what ``node`` holds; open elements are kept in a list of frames, so nesting has no limit."""
    first = lambda n: n.start if n.name == "ol" and n.start is not None else 1
    frames: list[list] = [[iter(node.children), node, depth, pre, shown, first(node), 0]]
    while frames:
        children, node, depth, pre, shown, count, gap = frame = frames[-1]
        child = next(children, None)
        if child is None:
            frames.pop()
            if gap:
                if node.name in ("li", "dd"):
                    w.prefix = ""
                w.gap(gap)
        elif isinstance(child, str):
            if not shown:
                continue
            if pre:
                w.literal(child.replace("\r\n", "\n"))
            else:
                w.text(child)
        elif not child.hidden:
            name, seen = child.name, shown if child.shown is None else child.shown
            if name == "br":
                w.more()
            elif name == "hr":
                w.gap(1)
            elif name == "table":
                w.gap(2)
                w.literal(_table(child, depth, seen))
                w.gap(2)
            elif name in BLOCK:
                nested = name in ("ul", "ol", "menu", "dir")
                gap = 2 if name in SPACED and not (depth and nested) else 1
                w.gap(gap)
                if name == "li":
                    count = child.start if child.start is not None else count
                    if seen:
                        w.prefix = "  " * max(0, depth - 1) + (f"{count}. " if node.name == "ol" else "- ")
                    frame[5] = count + 1
                elif name == "dd":
                    w.prefix = "  "
                frames.append([iter(child.children), child, depth + nested, pre or name == "pre", seen, first(child), gap])
            else:
                frames.append([iter(child.children), child, depth, pre, seen, 1, 0])


def _rows(table: Node, shown: bool) -> Iterator[tuple[str, list[tuple[Node, bool]]]]:
    """The rows of a table by their cells, and whatever else stands between rows or cells; each with its visibility."""
    frames: list[tuple] = [(iter(table.children), table, shown, [])]
    while frames:
        children, node, shown, row = frames[-1]
        child = next(children, None)
        if child is None:
            frames.pop()
            if node.name == "tr":
                yield "row", row
        elif isinstance(child, Node):
            if child.hidden:
                continue
            seen = shown if child.shown is None else child.shown
            if node.name == "tr" and child.name in ("td", "th"):
                row.append((child, seen))
            elif child.name in ("tr", "tbody", "thead", "tfoot", "colgroup"):
                frames.append((iter(child.children), child, seen, []))
            else:
                yield "other", [(child, seen)]
        elif not child.isspace():
            text = Node("span")
            text.children.append(child)
            yield "other", [(text, shown)]


def _table(node: Node, depth: int, shown: bool) -> str:
    """Cells side by side, columns as wide as their widest line; text between rows stands before the grid.

    A cell that spans columns widens the last of them if it needs more room than they
    have; one that spans rows shows its text in the first.
    """
    before, grid, taken = [], [], {}
    for kind, cells in _rows(node, shown):
        if kind != "row":
            before += [t for c, seen in cells if (t := _inside(c, depth, seen))]
            continue
        row, column = [], 0
        for cell, seen in cells:
            while taken.get(column, 0) > 0:
                column += 1
            wide, high = cell.span
            row.append((column, wide, _inside(cell, depth, seen).split("\n")))
            for k in range(column, column + wide):
                taken[k] = max(taken.get(k, 0), high)
            column += wide
        taken = {k: n - 1 for k, n in taken.items() if n > 1}
        grid.append(row)
    widths: dict[int, int] = {}
    for row in grid:
        for at, wide, cell in row:
            if wide == 1:
                widths[at] = max(widths.get(at, 0), *map(len, cell))
    for row in grid:
        for at, wide, cell in row:
            if wide > 1:
                short = max(map(len, cell)) - sum(widths.get(k, 0) for k in range(at, at + wide)) - 2 * (wide - 1)
                widths[at + wide - 1] = widths.get(at + wide - 1, 0) + max(0, short)
    starts, right = {}, 0
    for k in range(max(widths, default=-1) + 1):
        starts[k] = right
        right += widths.get(k, 0) + 2
    lines = list(before)
    for row in grid:
        for k in range(max((len(cell) for _, _, cell in row), default=0)):
            line = ""
            for at, _, cell in row:
                if k < len(cell) and cell[k]:
                    line = line.ljust(starts[at]) + cell[k]
            if line.rstrip():
                lines.append(line.rstrip())
    return "\n".join(lines)


def _inside(node: Node, depth: int, shown: bool) -> str:
    w = _Writer()
    _render(node, w, depth, False, shown)
    return "".join(w.out)


def html_to_text(source: str | None) -> str:
    """All visible text of a page; empty for null, empty and invisible ones."""
    if not source:
        return ""
    # tables within tables are laid out by recursion, a few plain Python frames each
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))
    return _inside(build(source), 0, True)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, out, held = [], [], 0
        for key, page in zip(batch.column("key").to_pylist(), batch.column("html"), strict=True):
            keys.append(key)
            out.append(html_to_text(page.as_py()))
            held += len(out[-1])
            if held > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, pa.string())], ["key", "text"])
                keys, out, held = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, pa.string())], ["key", "text"])


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, ``text`` and ``n_chars`` of each row of ``pages``; null pages have an empty text, null ids and repeated rows stay."""
    slim = pages.select(F.col(f"`{id_col}`").cast("long").alias("key"), F.col(f"`{html_col}`").cast("string").alias("html"))
    return slim.mapInArrow(_texts, "key long, text string").select(F.col("key").alias(id_col), "text", F.length("text").cast("long").alias("n_chars"))
