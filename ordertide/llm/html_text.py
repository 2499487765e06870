"""HTML extraction: the visible text of a page, laid out as a browser would.

A tree builder reads the tags: it closes what the standard lets authors leave open (p, li, dt, dd, option, table
parts), ignores end tags that match nothing, and takes script, style and the like as raw text. Rendering
walks the tree once. It leaves out what is not shown (head, scripts, ``hidden``, ``display: none``, closed
dialogs and details, what a drawing only defines), collapses white space except in ``pre``, keeps lines and blank
lines between blocks, numbers or marks list items and indents nested lists, shows formulas, the text of drawings
and the labels of buttons, and sets table cells in aligned columns, with cells that span columns or rows in their
place.

Defined results: a null or empty page gives an empty text, a page without tags its text. Unclosed comments, raw
text and tags reach to the end. Repeated rows stay. An empty table gives an empty result. Other columns are
not read.

Scale: one pass over the pages, no shuffle. Reading and rendering use no recursion. Where padding a table's
columns to their widest cells would make it over ``PADDING`` times as long as its words, columns are padded to
``WIDEST`` characters at most, so time and memory follow the page.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDEST, PADDING = 40, 4
ROMAN = (
    (1000, 10_000, "m"), (500, 1000, "d"), (100, 500, "c"), (50, 100, "l"), (10, 50, "x"), (5, 10, "v"), (1, 5, "i"),
)
ROMAN_SHORT = (("dcccc", "cm"), ("cccc", "cd"), ("lxxxx", "xc"), ("xxxx", "xl"), ("viiii", "ix"), ("iiii", "iv"))
GAP = "  "

# Fixed by the standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript plaintext".split())
UNSHOWN = frozenset(
    "head script style title template noscript noembed noframes iframe object video audio canvas datalist "
    "meta link base param source track area".split()
)
# Inside drawings only text elements and embedded pages show text; formulas do not show their annotations.
DRAWN = frozenset("text foreignobject".split())
NOT_DRAWN = frozenset("defs desc metadata symbol clippath mask marker pattern".split())
ANNOTATIONS = frozenset("annotation annotation-xml".split())
BUTTONS = frozenset("submit reset button".split())
PARAGRAPHS = frozenset(
    "p h1 h2 h3 h4 h5 h6 ul ol dl menu blockquote pre table figure hr fieldset xmp listing".split()
)
BLOCKS = PARAGRAPHS | frozenset(
    "html body address article aside center details dialog dd div dir dt figcaption footer form "
    "header hgroup legend li main nav optgroup option search section summary tr caption".split()
)
CLOSES_P = (BLOCKS - frozenset("html body tr caption option optgroup legend".split())) | {"plaintext"}
# An opening tag ends these open elements, looking up to (not through) the limits.
ENDED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th", "caption", "colgroup"}, {"tr", "table"}),
    "th": ({"td", "th", "caption", "colgroup"}, {"tr", "table"}),
    "body": ({"head"}, {"html"}),
} | {
    part: ({"tr", "td", "th", "caption", "colgroup", "thead", "tbody", "tfoot"}, {"table"})
    for part in ("thead", "tbody", "tfoot", "caption", "colgroup")
}
BARRIERS = frozenset({"table", "td", "th", "caption", "html", "template", "object", "button"})
HEAD_PARTS = frozenset("title base link meta style script noscript template head html".split())

TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
BARE_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)")
BLANKS = re.compile("[ \t\n\f\r]+")
COMMENT_END = re.compile("--!?>")


class Node:
    """An element: its tag, attributes, and children (elements and strings)."""

    __slots__ = ("attributes", "children", "tag")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes = tag, attributes
        self.children: list[Node | str] = []


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(source):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return found


class Builder:
    """Builds the tree of one page. Counts of what is open keep each step from searching the whole stack."""

    def __init__(self) -> None:
        self.root = Node("html", {})
        self.open = [self.root]
        self.counts: Counter[str] = Counter()  # open elements by tag
        self.inside: list[Counter[str]] = [Counter()]  # the same since the last barrier

    def _push(self, node: Node) -> None:
        self.open.append(node)
        self.counts[node.tag] += 1
        self.inside[-1][node.tag] += 1
        if node.tag in BARRIERS:
            self.inside.append(Counter())

    def _cut(self, size: int) -> None:
        """Close all but the first ``size`` open elements."""
        while len(self.open) > size:
            tag = self.open.pop().tag
            if tag in BARRIERS:
                self.inside.pop()
            self.counts[tag] -= 1
            self.inside[-1][tag] -= 1

    def text(self, text: str) -> None:
        if text.strip(" \t\n\f\r"):
            self._leave_head()
        self.open[-1].children.append(html.unescape(text) if "&" in text else text)

    def raw(self, text: str, tag: str) -> None:
        self.open[-1].children.append(html.unescape(text) if tag in ("title", "textarea") else text)

    def _leave_head(self) -> None:
        if self.open[-1].tag == "head":
            self._cut(len(self.open) - 1)

    def start(self, tag: str, attributes: dict[str, str], closed: bool = False) -> None:
        """An opening tag; one ``closed`` by a slash has no content inside drawings and formulas."""
        if tag == "html":
            self.root.attributes = attributes | self.root.attributes
            return
        if tag not in HEAD_PARTS:
            self._leave_head()
        if tag in CLOSES_P and self.inside[-1]["p"]:
            self._cut(max(i for i, node in enumerate(self.open) if node.tag == "p"))
        if tag in ENDED_BY:
            self._end_implied(*ENDED_BY[tag], once=tag in ("li", "dt", "dd", "option"))
        node = Node(tag, attributes)
        self.open[-1].children.append(node)
        if tag not in VOID and not (closed and (self.counts["svg"] or self.counts["math"] or tag in ("svg", "math"))):
            self._push(node)

    def _end_implied(self, ended: set[str], limits: set[str], once: bool) -> None:
        cut = None
        if any(self.counts[t] for t in ended):
            for i in range(len(self.open) - 1, 0, -1):
                name = self.open[i].tag
                if name in ended:
                    cut = i
                    if once:
                        break
                elif name in limits:
                    break
        if cut is not None:
            self._cut(cut)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.open[-1].children.append(Node("br", {}))
            return
        if tag == "p" and not self.inside[-1]["p"]:
            self.open[-1].children.append(Node("p", {}))
            return
        anywhere = tag in ("table", "td", "th", "tr", "caption", "tbody", "thead", "tfoot", "body", *BARRIERS)
        if not (self.counts if anywhere else self.inside[-1])[tag]:
            return
        for i in range(len(self.open) - 1, 0, -1):
            name = self.open[i].tag
            if name == tag:
                self._cut(i)
                return
            if name == "table" and tag not in ("table", "body"):
                return


def parsed(page: str) -> Node:
    builder = Builder()
    at, pattern = 0, TAG
    while True:
        start = page.find("<", at)
        if start < 0:
            builder.text(page[at:])
            return builder.root
        if page.startswith("<!--", start):
            builder.text(page[at:start])
            if page.startswith((">", "->"), start + 4):  # an empty comment
                at = page.index(">", start) + 1
            else:
                end = COMMENT_END.search(page, start + 4)
                at = end.end() if end else len(page)
            continue
        if page[start + 1 : start + 2] in ("!", "?"):
            end = page.find(">", start)
            builder.text(page[at:start])
            at = len(page) if end < 0 else end + 1
            continue
        if not (m := pattern.match(page, start)):
            if pattern is TAG and BARE_TAG.match(page, start):
                pattern = BARE_TAG  # a quote stays open to the end: from here on a tag ends at its first >
                continue
            begins = page[start + 1 : start + 2].isalpha() or page[start + 1 : start + 2] == "/"
            if begins and page.find(">", start) < 0:
                builder.text(page[at:start])
                return builder.root
            if page[at:start]:
                builder.text(page[at:start])
            builder.text("<")
            at = start + 1
            continue
        if start > at:
            builder.text(page[at:start])
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            builder.end(tag)
            continue
        attributes = _attributes(m[3]) if m[3].strip(" \t\n\f\r/") else {}
        closed = m[3].endswith("/")
        builder.start(tag, attributes, closed)
        if tag in RAW and not (closed and builder.open[-1].tag != tag):
            close = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(page, at)
            builder.raw(page[at : close.start() if close else len(page)], tag)
            at = close.start() if close else len(page)


# --- rendering -----------------------------------------------------------------------------------


def shown(node: Node) -> bool:
    attributes = node.attributes
    if node.tag in UNSHOWN:
        return False
    if not attributes:
        return node.tag != "dialog"
    if "hidden" in attributes or (node.tag == "dialog" and "open" not in attributes):
        return False
    if node.tag == "input" and attributes.get("type", "").lower() == "hidden":
        return False
    return not ("style" in attributes and NOT_SHOWN.search(attributes["style"].lower()))


class Page:
    """Text being laid out: lines, with blank lines between paragraphs."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.breaks = 0  # line ends owed before the next text
        self.empty = True  # nothing on the current line
        self.space = False  # a blank owed before the next word
        self.indent = ""
        self.marker = ""

    def line(self, n: int = 1) -> None:
        """Owe at least ``n`` line ends."""
        self.space = False
        self.breaks = max(self.breaks, n if not self.empty or self.breaks else min(n, self.breaks))

    def br(self) -> None:
        self.space = False
        if self.empty and not self.breaks:
            self.parts.append("\n")
        else:
            self.breaks += 1

    def _begin(self) -> None:
        if self.breaks and self.parts:
            self.parts.append("\n" * self.breaks)
        if self.breaks or not self.parts or self.empty:
            lead = self.indent
            if self.marker:
                lead, self.marker = lead[: max(0, len(lead) - len(self.marker))] + self.marker, ""
            self.parts.append(lead)
        self.breaks, self.empty, self.space = 0, False, False

    def flow(self, text: str) -> None:
        words = BLANKS.split(text)
        if len(words) == 1 and not words[0]:
            return
        if not words[0]:
            self.space = True
        body = " ".join(w for w in words if w)
        if body:
            glue = " " if self.space and not (self.empty or self.breaks) else ""
            if self.empty or self.breaks:
                self._begin()
            self.parts.append(glue + body)
            self.space = False
        if not words[-1]:
            self.space = True

    def kept(self, text: str) -> None:
        """Text with its own lines."""
        for i, line in enumerate(text.split("\n")):
            if i:
                self.breaks += 1
            if line:
                if self.empty or self.breaks:
                    self._begin()
                self.parts.append(line)

    def result(self) -> str:
        lines = (line.rstrip() for line in "".join(self.parts).split("\n"))
        return "\n".join(lines).strip("\n")


class Table:
    """Cells in rows and columns; a cell that spans rows keeps its columns in the rows below."""

    def __init__(self) -> None:
        self.rows: list[list[str]] = []
        self.captions: list[str] = []
        self.held: dict[int, int] = {}  # rows for which a column is still taken from above

    def group(self) -> None:
        """A new group of rows: no cell reaches into it."""
        self.held = {}

    def row(self) -> None:
        self.held = {column: n - 1 for column, n in self.held.items() if n > 0}
        self.rows.append([])

    def add(self, cell: str, columns: int, rows: int) -> None:
        if not self.rows:
            self.row()
        row = self.rows[-1]
        while self.held.get(len(row), -1) >= 0:
            row.append("")
        if rows > 1:
            self.held |= {len(row) + i: rows - 1 for i in range(columns)}
        row += [cell] + [""] * (columns - 1)

    def result(self) -> str:
        rows = [[cell.split("\n") for cell in row] for row in self.rows if any(row)]
        widths: list[int] = []
        for row in rows:
            for i, cell in enumerate(row):
                if i == len(widths):
                    widths.append(0)
                widths[i] = max(widths[i], max(map(len, cell)))
        lines = sum(max(map(len, row)) for row in rows)
        words = sum(len(line) for row in rows for cell in row for line in cell)
        if lines * sum(widths) > PADDING * words + 10_000:  # a few very wide cells among many rows
            widths = [min(width, WIDEST) for width in widths]
        text = [line for caption in self.captions if caption for line in caption.split("\n")]
        for row in rows:
            for k in range(max(map(len, row))):
                cells = (cell[k] if k < len(cell) else "" for cell in row)
                pairs = zip(cells, widths, strict=False)  # a column without any text takes no room
                text.append(GAP.join(c.ljust(w) for c, w in pairs if w).rstrip())
        return "\n".join(text)


def _number(node: Node, name: str, default: int) -> int:
    value = node.attributes.get(name, "").strip()
    digits = value.removeprefix("-")
    return int(value) if digits.isascii() and digits.isdigit() and len(digits) < 9 else default


def _columns(node: Node) -> int:
    return min(max(_number(node, "colspan", 1), 1), 1000)


def _rows(node: Node) -> int:
    rows = _number(node, "rowspan", 1)
    return 65_534 if rows == 0 else min(max(rows, 1), 65_534)  # 0: to the end of the group


def _marker(kind: str, n: int) -> str:
    """What stands before an item: its number in the list's style, or a dash."""
    if kind == "-":
        return "- "
    text = str(n)
    if kind in "aA" and n > 0:
        text, left = "", n
        while left:
            left, digit = divmod(left - 1, 26)
            text = chr(ord("a") + digit) + text
    elif kind in "iI" and 0 < n < 4000:
        text = "".join(
            letters * (n % above // value) if value in (1000, 100, 10, 1) else letters * (n % above >= value)
            for value, above, letters in ROMAN
        )
        for long, short in ROMAN_SHORT:
            text = text.replace(long, short)
    return f"{text.upper() if kind in 'AI' else text}. "


def rendered(root: Node) -> str:
    """The text of a tree."""
    pages, tables = [Page()], [Table()]
    lists: list[list] = []  # kind, number of the next item, step
    indents: list[str] = []  # of open items, the line start outside them
    kept = 0  # depth of pre elements
    drawn: list[bool] = []  # of open drawings and their text elements, whether text shows
    formulas = 0
    work: list[tuple[Node | str, bool]] = [(root, False)]
    while work:
        node, leaving = work.pop()
        page = pages[-1]
        if isinstance(node, str):
            if not drawn or drawn[-1]:
                page.kept(node) if kept else page.flow(node)
            continue
        tag = node.tag
        if not leaving:
            if not shown(node) or (drawn and tag in NOT_DRAWN) or (formulas and tag in ANNOTATIONS):
                continue
            if tag == "br":
                page.br()
                continue
            if tag == "hr":
                page.line(2)
                continue
            if tag in BLOCKS and tag not in ("tr", "caption"):
                nested = tag in ("ul", "ol", "menu", "dir") and lists
                page.line(1 if nested or tag not in PARAGRAPHS else 2)
            if tag in ("pre", "xmp", "listing", "textarea"):
                kept += 1
            elif tag in ("ul", "menu", "dir"):
                lists.append(["-", 0, 1])
            elif tag == "ol":
                kind = node.attributes.get("type", "1")
                items = sum(isinstance(c, Node) and c.tag == "li" for c in node.children)
                backwards = "reversed" in node.attributes
                first = _number(node, "start", items if backwards else 1)
                lists.append([kind if kind in ("a", "A", "i", "I") else "1", first, -1 if backwards else 1])
            elif tag == "li":
                kind, n, step = lists[-1] if lists else ("-", 0, 1)
                n = _number(node, "value", n)
                indents.append(page.indent)
                page.marker = _marker(kind, n)
                page.indent += " " * len(page.marker)
                if lists:
                    lists[-1][1] = n + step
            elif tag in ("dd", "blockquote"):
                page.indent += "  "
            elif tag == "table":
                tables.append(Table())
            elif tag in ("thead", "tbody", "tfoot"):
                tables[-1].group()
            elif tag == "tr":
                tables[-1].row()
            elif tag in ("td", "th", "caption"):
                pages.append(Page())
            elif tag == "img" and node.attributes.get("alt"):
                page.flow(node.attributes["alt"])
            elif tag == "input" and node.attributes.get("type", "").lower() in BUTTONS:
                page.flow(node.attributes.get("value", ""))
            elif tag == "svg":
                drawn.append(False)
            elif drawn and tag in DRAWN:
                page.line()
                drawn.append(True)
            elif tag == "math":
                formulas += 1
            work.append((node, True))
            children = node.children
            if tag in ("pre", "listing", "textarea") and children and isinstance(children[0], str):
                children = [re.sub(r"^\r?\n", "", children[0]), *children[1:]]  # it belongs to the tag
            if tag == "details" and "open" not in node.attributes:
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
            work += [(child, False) for child in reversed(children)]
            continue
        if tag in ("pre", "xmp", "listing", "textarea"):
            kept -= 1
        elif tag in ("ul", "ol", "menu", "dir"):
            lists.pop()
        elif tag == "li":
            page.marker, page.indent = "", indents.pop()
        elif tag in ("dd", "blockquote"):
            page.indent = page.indent[:-2]
        elif tag in ("td", "th"):
            tables[-1].add(pages.pop().result(), _columns(node), _rows(node))
        elif tag == "caption":
            tables[-1].captions.append(pages.pop().result())
        elif tag == "table":
            text = tables.pop().result()
            if text:
                page.kept(text)
        elif tag == "svg":
            drawn.pop()
        elif drawn and tag in DRAWN:
            drawn.pop()
            page.line()
        elif tag == "math":
            formulas -= 1
        if tag in BLOCKS and tag not in ("tr", "caption"):
            nested = tag in ("ul", "ol", "menu", "dir") and lists
            page.line(1 if nested or tag not in PARAGRAPHS else 2)
    loose = tables[0].result()  # cells outside any table
    return "\n".join(t for t in (pages[0].result(), loose) if t)


def page_text(page: str | None) -> str:
    return rendered(parsed(page)) if page else ""


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [page_text(page.as_py()) for page in batch.column("html")]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.string())], ["id", "text"])


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id_col, text) of every row."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    id_type = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_texts, f"id {id_type}, text string").withColumnRenamed("id", id_col)
