"""Records of HTML and Markdown documents, for indexing.

html_records: a record for each run of text, with its element, its path in the
tree and the element's attributes; neighbouring texts of one kind are merged,
kept apart, or both. markdown_sections: a record for each heading, with the
headings above it and the text below. Parsing is the one thing Spark has no
expression for; it runs where the documents are, batch by batch.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Opening one of these ends an open one of those.
_ENDS = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
_HOLDS = frozenset("ul ol table tbody thead tfoot dl select div td th body".split())
MERGE = ("merge", "split", "both")
_WHITE = re.compile(r"[ \t\n\r\f]+")


class _Tree(HTMLParser):
    """Nested lists [tag, attributes, children]; text is a str among children."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root: list = ["", {}, []]
        self.stack = [self.root]

    def handle_starttag(self, tag, attrs):
        ends = _ENDS.get(tag, {"p"} if tag in _BLOCKS else set())
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] in ends:
                del self.stack[k:]
                break
            if self.stack[k][0] in _HOLDS and self.stack[k][0] != tag:
                break
        node = [tag, {k: v or "" for k, v in attrs}, []]
        self.stack[-1][2].append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                return

    def handle_data(self, data):
        kids = self.stack[-1][2]
        if kids and isinstance(kids[-1], str):
            kids[-1] += data
        else:
            kids.append(data)


Transform = Callable[[dict], dict]


def records_of_html(page: str, merge: str = "merge", base: str = "", transform: Transform | None = None) -> list[dict]:
    """type, content, path, properties of each text.

    transform gets {tag, content, properties} of an element and may change tag and
    properties, or replace the content by a text.
    """
    if merge not in MERGE:
        raise ValueError(f"merge is one of {MERGE}, not {merge}")
    tree = _Tree()
    tree.feed(page)
    tree.close()
    out: list[dict] = []
    # (node, its parent, path), in document order.
    stack = [(kid, tree.root, f"{base}root[{i}]") for i, kid in reversed(list(enumerate(_trimmed(tree.root))))]
    while stack:
        node, parent, path = stack.pop()
        if isinstance(node, str):
            _add(out, node, parent[0], path.rpartition(".")[0], parent[1], merge)
            continue
        tag, attrs, kids = node
        if transform:
            seen = {"tag": tag, "content": _text(node), "properties": attrs}
            new = transform(dict(seen))
            node = [new["tag"], dict(new["properties"]), kids if new["content"] == seen["content"] else [new["content"]]]
        kids = _trimmed(node)
        stack.extend((kid, node, f"{path}.{node[0]}[{i}]") for i, kid in reversed(list(enumerate(kids))))
    return out


def _text(node: list) -> str:
    out, stack = [], [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            stack.extend(reversed(x[2]))
    return "".join(out)


def _trimmed(node: list) -> list:
    """Children without insignificant white space; no text of scripts and styles."""
    if node[0] in ("script", "style"):
        return []
    if node[0] in ("pre", "textarea"):
        return node[2]
    out = []
    for kid in node[2]:
        if isinstance(kid, str):
            kid = _WHITE.sub(" ", kid).strip()
            if not kid:
                continue
        out.append(kid)
    return out


def _add(out: list[dict], content: str, tag: str, path: str, attrs: dict, merge: str) -> None:
    new = {"type": tag, "content": content, "path": path, "properties": attrs}
    last = out[-1] if out else None
    same = last is not None and last["type"] == tag and last["path"].rpartition("[")[0] == path.rpartition("[")[0]
    if merge == "split":
        out.append(new)
    elif not same:
        out.extend([new, dict(new)] if merge == "both" else [new])
    else:
        if merge == "both":
            out.insert(len(out) - 1, new)
        last["content"] += f" {content}"
        last["properties"] = {**attrs, **last["properties"]}


# -- Markdown ------------------------------------------------------------------------------

_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_RULE = re.compile(r" {0,3}([-*_])[ \t]*(?:\1[ \t]*){2,}$")
_ANCHOR = re.compile(r"\{#([^}]+)\}[ \t]*$")
_INLINE: list[tuple[re.Pattern, str]] = [
    (re.compile(r"<!--.*?-->", re.S), " "),
    (re.compile(r"!\[[^\]]*\](?:\([^)]*\)|\[[^\]]*\])?"), ""),
    (re.compile(r"<(?:https?|mailto|ftp):[^\s<>]*>"), ""),
    (re.compile(r"\[\^[^\]]+\]"), ""),
    (re.compile(r"\[([^\]]*)\](?:\([^)]*\)|\[[^\]]*\])"), r"\1"),
    (re.compile(r"</?[A-Za-z][^>]*>"), " "),
    (re.compile(r"(\*\*\*|\*\*|\*|~~)(?=\S)(.+?)(?<=\S)\1"), r"\2"),
    (re.compile(r"(?<![A-Za-z0-9_])(___|__|_)(?=\S)(.+?)(?<=\S)\1(?![A-Za-z0-9_])"), r"\2"),
]


def plain_inline(text: str) -> str:
    """Markdown's inline marks taken off; code spans keep their text."""
    out = []
    for k, part in enumerate(re.split(r"(`+[^`]+`+)", text)):
        if k % 2:
            out.append(part.strip("`"))
            continue
        for pattern, new in _INLINE:
            part = pattern.sub(new, part)
        out.append(re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", html.unescape(part)))
    return " ".join("".join(out).split())


def _slug(text: str) -> str:
    return re.sub(r"\s", "-", re.sub(r"[^\w\- ]", "", text.lower()))


def _front_matter(lines: list[str]) -> tuple[str | None, int]:
    if not lines or lines[0].rstrip() != "---":
        return None, 0
    for i in range(1, len(lines)):
        if lines[i].rstrip() == "---":
            for line in lines[1:i]:
                m = re.match(r"title\s*:\s*(.+?)\s*$", line)
                if m:
                    return " ".join(m[1].strip("\"'").split()) or None, i + 1
            return None, i + 1
    return None, 0


def sections_of_markdown(source: str) -> tuple[str | None, list[dict]]:
    """(title, sections of heading, anchor, level, ancestors, content)."""
    lines = source.replace("\r\n", "\n").split("\n")
    title, at = _front_matter(lines)
    first: str | None = None
    intro = {"heading": "", "anchor": "", "level": 0, "ancestors": [], "content": ""}
    current, sections, body, paragraph = intro, [], [], []
    above: dict[int, str] = {}
    used: dict[str, int] = {}

    def anchor_of(text: str) -> str:
        base = _slug(text)
        name = base
        while name in used:
            used[base] += 1
            name = f"{base}-{used[base]}"
        used[name] = 0
        return name

    def flush_paragraph() -> None:
        if paragraph:
            body.append(plain_inline(" ".join(paragraph)))
            paragraph.clear()

    def flush() -> None:
        flush_paragraph()
        current["content"] = " ".join(" ".join(b for b in body if b).split())
        body.clear()
        if current is not intro or intro["content"]:
            sections.append(current)

    def open_section(raw: str, level: int) -> None:
        nonlocal current, first
        flush()
        m = _ANCHOR.search(raw)
        text = plain_inline(raw[: m.start()] if m else raw)
        if level == 1 and first is None:
            first = text
        ancestors = [above[k] for k in sorted(above) if k < level and above[k]]
        for k in [k for k in above if k >= level]:
            del above[k]
        above[level] = text
        current = {"heading": text, "anchor": m[1].strip() if m else anchor_of(text), "level": level, "ancestors": ancestors, "content": ""}

    fence: str | None = None
    while at < len(lines):
        line = lines[at]
        at += 1
        m = _FENCE.match(line)
        if fence:
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not line.strip().strip(fence[0]):
                fence = None
            continue
        if m:
            flush_paragraph()
            fence = m[1]
            continue
        m = _ATX.match(line)
        if m:
            open_section(m[2] or "", len(m[1]))
            continue
        m = _SETEXT.match(line)
        if m and paragraph:
            raw = " ".join(paragraph)
            paragraph.clear()
            open_section(raw, 1 if m[1][0] == "=" else 2)
            continue
        if not line.strip() or _RULE.match(line):
            flush_paragraph()
            continue
        if line.startswith(("    ", "\t")) and not paragraph:
            continue  # indented code
        if re.match(r" {0,3}\[[^\]]+\]:\s*\S", line) and not paragraph:
            continue  # a link's definition
        if re.match(r"\s*\|?[ \t:|-]*-[ \t:|-]*\|[ \t:|-]*$", line):
            continue  # a table's rule
        text = re.sub(r"^\s*(?:>\s?|[-*+]\s+(?:\[[ xX]\]\s+)?|\d{1,9}[.)]\s+)+", "", line)
        if text != line:
            flush_paragraph()
        paragraph.append(text.replace("|", " ") if line.lstrip().startswith("|") else text)
    flush()
    return title or first, sections


# -- DataFrames ----------------------------------------------------------------------------

_HTML = "type string, content string, path string, properties string"
_SECTION = "title string, place int, heading string, anchor string, level int, ancestors array<string>, content string"


def _mapped(docs: DataFrame, key: str, text: str, parse: Callable[[str], list[tuple]], schema: str) -> DataFrame:
    """key and parse's rows for each document."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = docs.schema[key].dataType.simpleString()
    full = f"{key} {kind}, {schema}"
    arrow = to_arrow_schema(StructType.fromDDL(full))

    return docs.select(key, text).mapInArrow(lambda batches: parsed(batches, parse, arrow), full)


#: Characters of documents whose rows are held in Python at once, besides the last document's.
MOST_CHARS = 500_000


def parsed(batches: Iterator[pa.RecordBatch], parse: Callable[[str], list[tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """key and parse's rows of documents (key, text), in parts: a batch of documents
    becomes many times its size as Python's rows."""
    rows: list[tuple] = []

    def made() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(schema)
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], names=schema.names)

    for batch in batches:
        chars = 0
        for key, text in zip(batch.column(0), batch.column(1), strict=True):
            source = text.as_py() or ""
            k = key.as_py()
            rows += [(k, *r) for r in parse(source)]
            chars += len(source)
            if chars > MOST_CHARS:
                yield made()
                chars = 0
        yield made()


def html_records(docs: DataFrame, key: str, text: str = "html", merge: str = "merge", transform: Transform | None = None) -> DataFrame:
    """key, type, content, path, properties (JSON): records of each page."""

    def parse(page: str) -> list[tuple]:
        return [(r["type"], r["content"], r["path"], json.dumps(r["properties"], sort_keys=True, ensure_ascii=False)) for r in records_of_html(page, merge, transform=transform)]

    return _mapped(docs, key, text, parse, _HTML)


def markdown_sections(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, title, place, heading, anchor, level, ancestors, content: a row a section."""

    def parse(source: str) -> list[tuple]:
        title, sections = sections_of_markdown(source)
        return [(title, i, s["heading"], s["anchor"], s["level"], s["ancestors"], s["content"]) for i, s in enumerate(sections)]

    return _mapped(docs, key, text, parse, _SECTION)


def read_files(spark, pattern: str) -> DataFrame:
    """path, kind (html, md or mdx), text of the files that match."""
    files = spark.read.format("binaryFile").load(pattern).select("path", F.col("content").cast("string").alias("text"))
    return files.withColumn("kind", F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))).where(F.col("kind").isin("html", "htm", "md", "mdx"))


def site_records(files: DataFrame, base_url: str = "") -> DataFrame:
    """title, section, hierarchy, content, url, category, path of a site's Markdown files.

    A page's URL is its path without extension and without a last "index".
    """
    rows = markdown_sections(files.where(F.col("kind").isin("md", "mdx")).select("path", "text"), "path")
    bare = F.regexp_replace(F.regexp_replace("path", r"\.mdx?$", ""), r"(^|/)index$", "$1")
    url = F.concat(F.lit(base_url), bare, F.when(F.col("anchor") != "", F.concat(F.lit("#"), F.col("anchor"))).otherwise(F.lit("")))
    category = F.element_at(F.filter(F.split(bare, "/"), lambda p: p != ""), -2)
    many = F.size(F.filter(F.split(bare, "/"), lambda p: p != "")) > 1
    return rows.select(
        F.coalesce("title", F.lit("")).alias("title"), F.col("heading").alias("section"), F.array_join("ancestors", " > ").alias("hierarchy"), "content", url.alias("url"), F.when(many, category).alias("category"), "path"
    )
