"""Visible text of HTML pages, laid out as a reader sees it.

A scanner cuts a page into tags, text and raw text; a tree builder adds implied
end tags (p, li, dt, dd, option, table parts) and drops what nests wrongly; a
renderer walks the tree without recursion. Blocks stand on lines of their own,
paragraphs and headings with an empty line around them; list items have their
mark and depth; table cells are padded to the width of their column; pre keeps
its spaces. Nothing hidden is given: head, script, style, template and their
like, the hidden attribute, display:none and visibility:hidden (under which
visibility:visible shows again).

Defined results: null html gives null text; an empty page gives ''; text outside
any tag is text; an open tag at the end of the page is dropped, any other tag
that is not closed ends with its parent; repeated rows each give their row; other
columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gives_back, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript title meta link base iframe noembed noframes object audio video canvas datalist annotation annotation-xml metadata desc defs".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table caption ul".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure".split())
ENDS_P = BLOCK - {"html", "body", "legend", "caption", "option", "optgroup"}
TABLE_PARTS = frozenset("caption colgroup thead tbody tfoot tr td th".split())
#: What an opening tag closes, and what stops the search for it.
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "tr": (frozenset(["tr", "td", "th", "caption", "colgroup"]), frozenset(["table", "thead", "tbody", "tfoot"])),
    "td": (frozenset(["td", "th", "caption", "colgroup"]), frozenset(["table", "tr", "thead", "tbody", "tfoot"])),
    **{k: (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])) for k in ("thead", "tbody", "tfoot", "caption", "colgroup")},
}
CLOSES["th"] = CLOSES["td"]
#: Elements that an end tag inside them cannot reach past.
SCOPE = frozenset("table td th caption html template".split())

_TAG = re.compile(r"<(?:!--(.*?)(?:--!?>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=(?!\s*[\"']))*)(?:>|\Z))", re.S)
_OPENS = re.compile(r"</?[a-zA-Z]")
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_STYLE = re.compile(r"(display|visibility)\s*:\s*([a-z-]+)", re.I)


class Node:
    __slots__ = ("attrs", "kids", "name")

    def __init__(self, name: str, attrs: str = ""):
        self.name, self.attrs, self.kids = name, attrs, []

    def attributes(self) -> dict[str, str]:
        return {k.lower(): html.unescape(v.strip("\"'")) for k, v in _ATTR.findall(self.attrs)} if self.attrs else {}


def parse(page: str) -> Node:
    """The page's tree, under a root of no name."""
    root = Node("")
    stack = [root]
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            stack[-1].kids.append(html.unescape(page[at:]))
            break
        m = _TAG.match(page, lt)
        if not m and _OPENS.match(page, lt):  # a value whose quote is never closed
            if lt > at:
                stack[-1].kids.append(html.unescape(page[at:lt]))
            break
        if not m:  # a bare sign
            nxt = page.find("<", lt + 1)
            nxt = n if nxt < 0 else nxt
            stack[-1].kids.append(html.unescape(page[at:nxt]))
            at = nxt
            continue
        if lt > at:
            stack[-1].kids.append(html.unescape(page[at:lt]))
        at = m.end()
        name = m[3]
        if not name:
            continue
        name = name.lower()
        if m[2]:
            _close(stack, name)
            continue
        if not page.endswith(">", lt, at):  # cut off inside a tag
            break
        _imply(stack, name)
        node = Node(name, m[4])
        stack[-1].kids.append(node)
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(f"</{re.escape(name)}(?=[\\s/>])[^>]*>", re.I).search(page, at)
            node.kids.append(page[at : end.start() if end else n])
            at = end.end() if end else n
            continue
        stack.append(node)
    return root


def _imply(stack: list[Node], name: str) -> None:
    """Close what the opening tag ends."""
    if name in ENDS_P:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name == "p":
                del stack[k:]
                break
            if stack[k].name in SCOPE or stack[k].name == "button":
                break
    if name in CLOSES:
        ends, stops = CLOSES[name]
        cut = None
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in ends:
                cut = k
                if name not in ("tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"):
                    break
            elif stack[k].name in stops:
                break
        if cut is not None:
            del stack[cut:]
    if name == "head" or name == "body":
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name == "head":
                del stack[k:]
                break
    elif stack[-1].name == "head" and name not in HIDDEN:
        stack.pop()  # the head ends where content starts


def _close(stack: list[Node], name: str) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].name == name:
            del stack[k:]
            return
        if stack[k].name in SCOPE and name not in TABLE_PARTS and name not in ("table", "html", "body"):
            return
        if stack[k].name == "table" and name in TABLE_PARTS:
            return
    if name == "br":
        stack[-1].kids.append(Node("br"))


class Lines:
    """Text on its way out: lines, the empty lines due, the line being filled."""

    def __init__(self):
        self.out: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.gap = 0
        self.mark = ""

    def text(self, s: str) -> None:
        words = _SPACE.sub(" ", s)
        if not words:
            return
        if words[0] == " ":
            self.space = True
            words = words[1:]
        if not words:
            return
        if self.line and self.space:
            self.line.append(" ")
        elif not self.line:
            self._lead()
        self.space = words[-1] == " "
        self.line.append(words[:-1] if self.space else words)

    def _lead(self) -> None:
        if self.mark:
            self.line.append(self.mark)
            self.mark = ""

    def end(self, gap: int = 0, force: bool = False) -> None:
        """End the line; at least `gap` empty lines before the next."""
        if self.line or force:
            if self.out and self.gap:
                self.out += [""] * self.gap
            self.gap = 0
            self.out.append("".join(self.line))
            self.line = []
        self.space = False
        self.gap = max(self.gap, gap)

    def raw(self, lines: list[str]) -> None:
        for one in lines:
            self._lead()
            self.line.append(one)
            self.end(force=True)


def _style(node: Node, visible: bool) -> tuple[bool, bool]:
    """Whether it is left out whole, and whether its own text shows."""
    if node.name in HIDDEN:
        return True, visible
    if node.attrs:
        a = node.attributes()
        if "hidden" in a or (node.name == "dialog" and "open" not in a):
            return True, visible
        for what, how in _STYLE.findall(a.get("style", "")):
            if what.lower() == "display" and how.lower() == "none":
                return True, visible
            if what.lower() == "visibility":
                visible = how.lower() not in ("hidden", "collapse")
    elif node.name == "dialog":
        return True, visible
    return False, visible


def render(root: Node) -> str:
    return "\n".join(_lines(root, True)).strip("\n")


#: Tables inside tables are laid out to this depth; further in, a row is a line and
#: its cells are parted by a space.
NESTED = 20


def _chosen(select: Node) -> list[Node]:
    """The options that show: those selected, else the first of a closed list, else all."""
    options, stack = [], [select]
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            continue
        if node.name == "option":
            options.append(node)
        else:
            stack.extend(reversed(node.kids))
    attributes = select.attributes() if select.attrs else {}
    if "multiple" in attributes or attributes.get("size", "1") != "1":
        return options
    return [x for x in options if x.attrs and "selected" in x.attributes()][-1:] or options[:1]


def _lines(root: Node, visible: bool, nested: int = 0) -> list[str]:
    o = Lines()
    # (node, visible, in pre, list depth, state of its list), entered or left
    stack: list[tuple] = [(root, visible, False, 0, None, False)]
    while stack:
        node, shown, pre, depth, items, leaving = stack.pop()
        if isinstance(node, str):
            if not shown:
                continue
            if pre:
                parts = node.replace("\r\n", "\n").split("\n")
                for k, part in enumerate(parts):
                    if k:
                        o.end(force=True)
                    if part:
                        o._lead()
                        o.line.append(part)
            else:
                o.text(node)
            continue
        name = node.name
        if leaving:
            o.mark = "" if name in ("li", "dt", "dd") else o.mark
            o.end(1 if name in SPACED and not (name in ("ul", "ol") and depth) else 0)
            continue
        if name:
            gone, shown = _style(node, shown)
            if gone:
                continue
            if name == "br":
                o.end(force=True)
                continue
            if name == "img":
                alt = node.attributes().get("alt", "")
                if alt and shown:
                    o.text(alt)
                continue
            if name in VOID and name != "hr":
                continue
            if name in BLOCK:
                o.end(1 if name in SPACED and not (name in ("ul", "ol") and depth) else 0)
                stack.append((node, shown, pre, depth, items, True))
        if name == "table" and nested < NESTED:
            o.raw(_table(node, shown, nested + 1))
            continue
        if name == "tr":
            o.end()
        elif name in ("td", "th"):
            o.text(" ")
        elif name == "select":
            for option in _chosen(node):
                stack.extend((kid, shown, pre, depth, items, False) for kid in reversed(option.kids))
            continue
        if name in ("ul", "menu", "dir"):
            depth, items = depth + 1, None
        elif name == "ol":
            start = node.attributes().get("start", "1")
            depth, items = depth + 1, [int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1]
        elif name == "li":
            mark = "- "
            if items:
                mark = f"{items[0]}. "
                items[0] += 1
            o.mark = "  " * max(depth - 1, 0) + mark
        elif name == "dd":
            o.mark = "  "
        elif name == "pre":
            pre = True
            if node.kids and isinstance(node.kids[0], str) and node.kids[0].startswith("\n"):
                node.kids[0] = node.kids[0][1:]
        stack.extend((kid, shown, pre, depth, items, False) for kid in reversed(node.kids))
    o.end()
    return o.out


def _table(node: Node, visible: bool, nested: int) -> list[str]:
    """A table's lines: cells side by side, padded to their columns' widths."""
    captions: list[str] = []
    rows: list[list[str]] = []
    loose: list = []
    under: dict[int, int] = {}  # column: rows that a cell above still spans
    stack: list[tuple] = [(kid, visible) for kid in reversed(node.kids)]
    while stack:
        kid, shown = stack.pop()
        if isinstance(kid, str):
            if kid.strip() and shown:
                loose.append(_SPACE.sub(" ", kid.strip()))
            continue
        gone, shown = _style(kid, shown)
        if gone:
            continue
        if kid.name == "caption":
            captions += _cell(kid, shown, nested)
        elif kid.name == "tr":
            cells: list[str] = []
            for c in kid.kids:
                if isinstance(c, str):
                    if c.strip() and shown:
                        loose.append(_SPACE.sub(" ", c.strip()))
                    continue
                away, seen = _style(c, shown)
                if away:
                    continue
                while under.get(len(cells)):
                    under[len(cells)] -= 1
                    cells.append("")
                wide, high = _span(c, "colspan", 1000), _span(c, "rowspan", 65_534)
                if high > 1:
                    under |= dict.fromkeys(range(len(cells), len(cells) + wide), high - 1)
                cells += [" ".join(x for x in _cell(c, seen, nested) if x), *[""] * (wide - 1)]
            for k in [k for k in under if k >= len(cells)]:
                under[k] -= 1
            under = {k: n for k, n in under.items() if n > 0}
            rows.append(cells)
        elif kid.name in ("td", "th"):
            rows.append([" ".join(x for x in _cell(kid, shown, nested) if x)])
        else:
            stack.extend((k, shown) for k in reversed(kid.kids))
    widths: list[int] = []
    for r in rows:
        widths += [0] * (len(r) - len(widths))
        for k, c in enumerate(r):
            widths[k] = max(widths[k], len(c))
    laid = ["  ".join(c.ljust(w) for c, w in zip(r, widths, strict=False)).rstrip() for r in rows if any(r)]
    return loose + captions + laid


def _span(cell: Node, name: str, most: int) -> int:
    n = cell.attributes().get(name, "1") if cell.attrs else "1"
    if not re.fullmatch(r"\d{1,9}", n):
        return 1
    # No number of rows stands for all that follow.
    return min(int(n), most) or (most if name == "rowspan" else 1)


def _cell(node: Node, visible: bool, nested: int) -> list[str]:
    """The lines of a cell's inside."""
    inside = Node("")
    inside.kids = node.kids
    return _lines(inside, visible, nested)


def extract(page: str | None) -> str | None:
    return None if page is None else render(parse(page))


def html_text(pages: DataFrame, source: str = "html", out: str = "text") -> DataFrame:
    """page_id, url and the visible text of each page."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [extract(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string())], names=["page_id", "url", out])

    return pages.select(F.col("page_id").cast("long"), "url", source).mapInArrow(run, f"page_id long, url string, {out} string")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(table(spark, sf_dir, "pages"))


QUERIES = {"op2_html_text": op2_html_text}
ORACLES: dict[str, str] = {}
