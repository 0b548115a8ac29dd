"""HTML extraction by layout-aware rendering.

A scanner reads a page's tags, a tree builder opens and closes elements (implied end tags, void elements, stray end
tags), visibility rules leave out what a browser doesn't show, and a renderer writes all visible text: white space
collapsed as in a browser, a blank line between paragraphs, headings, lists and tables, a line for each other block,
markers and indents for list items, and table cells in aligned columns; cells of a table of one column are blocks. Text is kept
verbatim in `pre` and `textarea`. Every part reads a page once, so that time is in proportion to its length (but for what
padding deeply nested tables itself takes).

Defined results: a null or empty page renders to an empty text; broken markup never fails (what isn't a tag is
text; an element left open ends with the page; a tag that the page's end cuts off is dropped); a null page_id is kept; repeated rows render alike; an empty table
gives an empty result; other columns are kept, but an existing column of the result's name is replaced.
"""

from __future__ import annotations

import bisect
import html as entities
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: A comment, declaration or tag. Quotes count only after an equals sign; possessive, so that nothing is read twice.
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)?+)*+)(>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACE = re.compile(r"[ \t\n\r\f]+")

# Fixed values of the HTML standard: void elements, raw text, elements that browsers don't show, blocks
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head title script style template noscript iframe noembed noframes datalist object audio video canvas annotation annotation-xml desc defs metadata symbol clippath".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr".split())
BLOCK = SPACED | frozenset("address article aside body center details dialog dd div dt fieldset figcaption footer form header html legend li main menu nav section summary caption tr".split())
#: An open element of the second set ends when one of the key opens, unless a barrier lies between.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "body": ({"head"}, set()),
}
#: An open paragraph ends when one of these opens.
ENDS_P = (BLOCK - {"html", "body", "tr", "caption", "dd", "dt", "li", "legend", "summary"}) | {"li", "dd", "dt"}
UNSEEN = re.compile(r"display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"visibility\s*:\s*(visible|hidden|collapse)", re.I)


class Node:
    """An element. hid: its own text isn't visible; in_item: it stands in a list item, not in a table within it; lines: the layout of a table."""

    __slots__ = ("attributes", "children", "hid", "in_item", "lines", "name", "next_number", "parent")

    def __init__(self, name: str, attributes: dict[str, str], parent: Node | None):
        self.name, self.attributes, self.parent, self.children, self.lines, self.next_number = name, attributes, parent, [], None, None
        above = parent.name if parent else ""
        self.in_item = above in ("li", "dd") or bool(parent and parent.in_item and above not in ("table", "td", "th"))
        style = VISIBILITY.findall(attributes["style"]) if "style" in attributes else None
        self.hid = style[-1].lower() != "visible" if style else bool(parent and parent.hid)


class Open:
    """The elements that are open, outermost first, and where each name stands among them."""

    def __init__(self) -> None:
        self.root = self.here = Node("", {}, None)
        self.nodes: list[Node] = []
        self.places: dict[str, list[int]] = {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.name, []).append(len(self.nodes))
        self.nodes.append(node)
        self.here = node

    def pop_to(self, depth: int) -> None:
        while len(self.nodes) > depth:
            self.places[self.nodes.pop().name].pop()
        self.here = self.nodes[-1] if self.nodes else self.root

    def close(self, names: set[str], barriers: set[str]) -> None:
        """End the outermost open element of these names inside the innermost barrier."""
        limit = max((self.places[b][-1] for b in barriers if self.places.get(b)), default=-1)
        inside = [p[k] for n in names if (p := self.places.get(n)) and (k := bisect.bisect(p, limit)) < len(p)]
        if inside:
            self.pop_to(min(inside))

    def end(self, name: str) -> bool:
        if self.places.get(name):
            self.pop_to(self.places[name][-1])
            return True
        return False


def tree(page: str) -> tuple[Node, list[Node]]:
    """The page's elements, with strings as leaves, and its tables in order."""
    open_, tables = Open(), []
    at, end = 0, len(page)

    def text(raw: str) -> None:
        open_.here.children.append(entities.unescape(raw))

    while at < end:
        m = TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if m[0].startswith("<![CDATA["):
            open_.here.children.append(m[0][9:].removesuffix("]]>"))
        if not name:
            continue
        if not m[4]:  # the page ends within a tag, which browsers drop
            break
        if m[1]:
            if not open_.end(name) and name == "br":
                open_.here.children.append(Node("br", {}, open_.here))
            continue
        if name in ENDS_P:
            open_.close({"p"}, {"table", "td", "th", "caption", "button", "object"})
        if re.fullmatch("h[1-6]", name) and re.fullmatch("h[1-6]", open_.here.name):
            open_.pop_to(len(open_.nodes) - 1)
        if name in IMPLIED_END:
            open_.close(*IMPLIED_END[name])
        attributes: dict[str, str] = {}
        for a in ATTRIBUTE.finditer(m[3]) if m[3] and not m[3].isspace() else ():
            attributes.setdefault(a[1].lower(), entities.unescape(next((x for x in a.groups()[1:] if x is not None), "")))
        node = Node(name, attributes, open_.here)
        open_.here.children.append(node)
        if name == "table":
            tables.append(node)
        if name in RAW:
            stop = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at)
            raw = page[at : stop.start() if stop else end]
            node.children.append(entities.unescape(raw) if name in ("title", "textarea") else raw)
            at = stop.end() if stop else end
        elif name not in VOID:
            open_.push(node)
    return open_.root, tables


def visible(node: Node) -> bool:
    """Whether a browser lays the element out; `hid` tells whether its text then shows."""
    a = node.attributes
    shut = node.name == "dialog" and "open" not in a
    return not (shut or node.name in HIDDEN or "hidden" in a or (node.name == "input" and a.get("type", "").lower() == "hidden") or UNSEEN.search(a.get("style", "")))


def width(text: str) -> int:
    """Columns that a text takes: wide characters take two, combining ones none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


#: Inputs that show no text of theirs, and what browsers write on a button without a value.
MUTE = {"checkbox", "color", "file", "hidden", "password", "radio", "range"}
LABELS = {"reset": "Reset", "submit": "Submit"}
#: Levels of quotes and lists that are indented; deeper ones stay at the last, so that a page of nested ones doesn't grow with its square.
LEVELS = 24


class Renderer:
    """Lines of text; `gap` is how many line ends are due before the next text."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line = ""
        self.gap = 0
        self.prefix: list[str] = []
        self.marker = ""

    def break_to(self, gap: int) -> None:
        if self.line:
            self.lines.append(self.line.rstrip())
            self.line = ""
        self.gap = max(self.gap, gap)

    def start(self) -> None:
        if not self.line:
            if self.lines and self.gap > 1:
                self.lines.append("")
            self.gap = 0
            self.line = "".join(self.prefix) + self.marker
            if self.marker:
                self.marker = ""

    def text(self, raw: str, pre: bool) -> None:
        if pre:
            for k, part in enumerate(raw.replace("\r\n", "\n").split("\n")):
                if k:
                    self.start()
                    self.lines.append(self.line.rstrip())
                    self.line = ""
                if part:
                    self.start()
                    self.line += part
            return
        s = SPACE.sub(" ", raw)
        if s == " ":
            if self.line and not self.line.endswith(" "):
                self.line += " "
            return
        if not s:
            return
        if not self.line:
            s = s.lstrip(" ")
            self.start()
        elif self.line.endswith(" "):
            s = s.lstrip(" ")
        self.line += s

    def indent(self, mark: str) -> None:
        self.prefix.append(mark if len(self.prefix) < LEVELS else "")

    def result(self) -> str:
        self.break_to(1)
        return "\n".join(self.lines)

    def render(self, children: list, hid: bool = False, pre: bool = False) -> Renderer:
        # an explicit stack, as a page may nest elements without bound
        stack: list[tuple] = []
        self.push(children, hid, pre, stack)
        while stack:
            what, node, pre = stack.pop()
            if what == "text":
                self.text(node, pre)
            elif what == "close":
                self.close(node)
            elif what == "break":
                self.break_to(node)
            else:
                self.open(node, pre, stack)
        return self

    @staticmethod
    def push(children: list, hid: bool, pre: bool, stack: list[tuple]) -> None:
        for child in reversed(children):
            if not isinstance(child, str):
                if visible(child):
                    stack.append(("open", child, pre))
            elif not hid:
                stack.append(("text", child, pre))

    def open(self, node: Node, pre: bool, stack: list[tuple]) -> None:
        name = node.name
        if name == "br":
            self.start()
            self.lines.append(self.line.rstrip())
            self.line = ""
            return
        if name == "table" and node.lines is not None:
            self.break_to(2)
            for line in node.lines:
                self.start()
                self.line += line
                self.break_to(1)
            self.break_to(2)
            return
        nested = name in ("ul", "ol", "menu") and node.in_item
        if name in BLOCK:
            self.break_to(2 if name in SPACED and not nested else 1)
            if name == "hr":
                self.start()
                self.line += "---"
                self.break_to(2)
                return
            if name == "li":
                self.marker = f"{_number(node)}. " if node.parent is not None and node.parent.name == "ol" else "- "
                self.prefix.append("")
            elif name == "blockquote":
                self.indent("> ")
            elif name == "dd":
                self.indent("    ")
            elif nested:
                self.indent("  ")
        elif name in ("td", "th"):
            self.text(" ", False)
        elif name == "input" and not node.hid:
            kind = node.attributes.get("type", "text").strip().lower()
            if kind == "image":
                self.text(node.attributes.get("alt", ""), False)
            elif kind not in MUTE:
                self.text(node.attributes.get("value", "") or (LABELS.get(kind, "") if "value" not in node.attributes else ""), False)
        pre = pre or name in ("pre", "textarea", "xmp")
        stack.append(("close", node, pre))
        if name == "table":  # of one column: its cells stand below one another
            captions, rows, loose = _grid(node)
            for row in reversed(rows):
                for cell in reversed(row):
                    stack.append(("break", 1, pre))
                    self.push(cell.children, cell.hid, pre, stack)
                    stack.append(("break", 1, pre))
            for x in reversed([*loose, *captions]):
                stack.append(("break", 1, pre))
                self.push([x], node.hid, pre, stack)
        elif name == "select":
            for option in reversed(_shown_options(node)):
                stack += [("text", " ", False), ("open", option, False)]
        elif name == "details" and "open" not in node.attributes:
            self.push([c for c in node.children if not isinstance(c, str) and c.name == "summary"][:1], node.hid, pre, stack)
        else:
            self.push(node.children, node.hid, pre, stack)

    def close(self, node: Node) -> None:
        name = node.name
        if name not in BLOCK:
            return
        nested = name in ("ul", "ol", "menu") and node.in_item
        if name == "li" and self.marker:
            self.start()  # an item without text
        self.break_to(2 if name in SPACED and not nested else 1)
        if name in ("li", "blockquote", "dd") or nested:
            self.prefix.pop()


def _grid(table: Node) -> tuple[list[Node], list[list[Node]], list]:
    """Captions, rows of cells, and what else stands in a table; browsers show that before it."""
    rows, captions, loose = [], [], []
    stack = list(reversed(table.children))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            loose += [x] if x.strip() else []
        elif not visible(x):
            continue
        elif x.name == "tr":
            rows.append([c for c in x.children if not isinstance(c, str) and c.name in ("td", "th") and visible(c)])
            loose += [c for c in x.children if (c.strip() if isinstance(c, str) else c.name not in ("td", "th") and visible(c))]
        elif x.name == "caption":
            captions.append(x)
        elif x.name in ("td", "th"):
            rows.append([x])
        elif x.name in ("thead", "tbody", "tfoot"):
            stack += reversed(x.children)
        else:
            loose.append(x)
    return captions, rows, loose


def lay_out(table: Node) -> None:
    """Lines of a table with several columns, whose inner tables are laid out already."""
    captions, rows, loose = _grid(table)
    if all(len(r) < 2 for r in rows):
        return
    lines = [line for x in [*loose, *captions] for line in Renderer().render([x], table.hid).result().split("\n") if line]
    held: list[tuple[int, int, int]] = []  # spans of columns that cells above cover, by their start, and the row where they end
    cells: list[dict[int, list[str]]] = []
    for r, row in enumerate(rows):
        line: dict[int, list[str]] = {}
        k, at, new = 0, 0, []
        for c in row:
            while at < len(held) and held[at][0] <= k:
                k, at = max(k, held[at][1]), at + 1
            line[k] = Renderer().render(c.children, c.hid).result().split("\n")
            wide, high = _span(c, "colspan", 1000), _span(c, "rowspan", 65534)
            if high > 1:
                new.append((k, k + wide, min(r + high, len(rows))))  # no cell goes beyond its table
            k += wide
        cells.append(line)
        merged: list[tuple[int, int, int]] = []
        for x in sorted([x for x in held if x[2] > r + 1] + [x for x in new if x[2] > r + 1]):
            if merged and merged[-1][2] == x[2] and merged[-1][1] >= x[0]:
                merged[-1] = (merged[-1][0], max(merged[-1][1], x[1]), x[2])
            else:
                merged.append(x)
        held = merged
    columns = sorted({k for line in cells for k in line})  # columns where no cell begins take no room
    widths = {k: max((width(t) for line in cells if k in line for t in line[k]), default=0) for k in columns}
    for line in cells:
        for i in range(max((len(c) for c in line.values()), default=0)):
            texts = [line[k][i] if k in line and i < len(line[k]) else "" for k in columns]
            shown = " | ".join(t + " " * (widths[k] - width(t)) for k, t in zip(columns, texts, strict=True)).rstrip()
            if shown.strip(" |"):
                lines.append(shown)
    table.lines = lines


def _shown_options(select: Node) -> list[Node]:
    """The options that a browser shows: all of a list box, of others the last one selected, or else the first."""
    options, stack = [], list(reversed(select.children))
    while stack:
        x = stack.pop()
        if isinstance(x, str) or not visible(x):
            continue
        if x.name == "option":
            options.append(x)
        else:
            stack += reversed(x.children)
    size = select.attributes.get("size", "")
    if "multiple" in select.attributes or (re.fullmatch(r"\d{1,9}", size) and int(size) > 1):
        return options
    chosen = [x for x in options if "selected" in x.attributes]
    return chosen[-1:] or [x for x in options if "disabled" not in x.attributes][:1] or options[:1]


def _number(item: Node) -> int:
    """An item's number in its ordered list."""
    whole = lambda raw: int(raw) if re.fullmatch(r"-?\d{1,9}", raw) else None
    ordered, own = item.parent, whole(item.attributes.get("value", ""))
    if ordered.next_number is None:
        first = whole(ordered.attributes.get("start", ""))
        ordered.next_number = 1 if first is None else first
    n = ordered.next_number if own is None else own
    ordered.next_number = n + 1
    return n


def _span(cell: Node, name: str, most: int) -> int:
    raw = cell.attributes.get(name, "1")
    return min(max(int(raw), 1), most) if re.fullmatch(r"\d{1,9}", raw) else 1


def render(page: str | None) -> str:
    """All visible text of a page."""
    root, tables = tree(page or "")
    for table in reversed(tables):  # inner tables first
        lay_out(table)
    return Renderer().render(root.children).result()


def extract(pages: DataFrame, column: str = "html", output: str = "text") -> DataFrame:
    """pages with the rendered text in place of the markup."""
    kept = [f for f in pages.schema.fields if f.name not in (column, output)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, column):
                texts = pa.array([render(x) for x in part.column(column).to_pylist()], pa.string())
                yield pa.record_batch([*(part.column(f.name) for f in kept), texts], names=[*(f.name for f in kept), output])

    return pages.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{output}` string"]))
