"""HTML fragments and book records to TEI, and books to HTML. Rules are data; a converter is one map-only pass.

Text after a child stays after it, and text outside of any rule becomes a paragraph, so nothing is lost or moved.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import unicode_strip
from quire.operators.shred import events, html_text, parse_attrs

#: Inline tags and their TEI rendition, and headings.
INLINE = {"i": "italic", "em": "italic", "b": "bold", "strong": "bold"}
HEADS = ("head", "h1", "h2", "h3", "h4", "h5", "h6")
FRONT = ("toc", "imprint", "cover", "cover-image", "title-page")


@dataclass
class Node:
    """An element; content holds nodes and strings in order."""

    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    content: list = field(default_factory=list)

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.content)


def parse(text: str) -> Node:
    """The fragment's tree under a nameless root, by the shredder's lenient rules."""
    import html

    root = Node("")
    stack = [root]
    for kind, name, attrs in events(text):
        if kind == "text":
            stack[-1].content.append(html.unescape(name))
        elif kind == "end":
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == name:
                    del stack[k:]
                    break
        else:
            node = Node(name, parse_attrs(attrs) if attrs else {})
            stack[-1].content.append(node)
            if kind == "start":
                stack.append(node)
    return root


def xml(tag: str, inner: str = "", /, **attrs: str) -> str:
    own = "".join(f" {k}={quoteattr(v)}" for k, v in attrs.items() if v is not None)
    return f"<{tag}{own}>{inner}</{tag}>" if inner else f"<{tag}{own}/>"


def markup(node: Node | str) -> str:
    """A node and all in it as markup, attributes in their order."""
    if isinstance(node, str):
        return node
    own = "".join(f" {k}={quoteattr(v)}" for k, v in node.attrs.items())
    return f"<{node.tag}{own}>{''.join(escape(c) if isinstance(c, str) else markup(c) for c in node.content)}</{node.tag}>" if node.content else f"<{node.tag}{own}/>"


class Converter:
    """Rule-based conversion; handled and unhandled tags are counted for the coverage report."""

    def __init__(self, copy_unknown: bool = False) -> None:
        """copy_unknown keeps unknown elements as they are instead of marking them as uncertain."""
        self.copy_unknown = copy_unknown
        self.handled: set[str] = set()
        self.unhandled: set[str] = set()

    def inline(self, node: Node) -> str:
        """Mixed content in document order: italics and bold to hi, breaks to lb, unknown elements to uncertain."""
        out = []
        for c in node.content:
            if isinstance(c, str):
                out.append(escape(c))
                continue
            if c.tag in ("lb", "br"):
                self.handled.add(c.tag)
                out.append("<lb/>")
            elif c.tag in INLINE or c.tag in ("hi", "span"):
                self.handled.add(c.tag)
                rend = INLINE.get(c.tag) or ("italic" if "italic" in c.attrs.get("style", "") else c.attrs.get("rend"))
                inner = self.inline(c)
                out.append(xml("hi", inner, rend=rend) if rend and inner else inner)
            elif c.tag in ("graphic", "img", "svg", "image"):
                out.append(self.graphic(c))
            elif c.tag in ("p", "a", "ref", "font", "small", "big", "sup", "sub", "u"):
                self.handled.add(c.tag)
                out.append(self.inline(c))
            else:
                self.unhandled.add(c.tag)
                out.append(xml(c.tag, self.inline(c), **c.attrs) if self.copy_unknown else xml("uncertain", self.inline(c), reason=c.tag))
        return "".join(out)

    def graphic(self, node: Node) -> str:
        self.handled.add(node.tag)
        if node.tag == "svg":
            inner = next((c for c in node.content if isinstance(c, Node) and c.tag == "image"), None)
            node = inner or node
        url = node.attrs.get("url") or node.attrs.get("src") or node.attrs.get("xlink:href") or node.attrs.get("href") or ""
        mime = node.attrs.get("mimetype")
        return xml("figure", xml("graphic", url=url, mimeType=mime, rend=node.attrs.get("rend")))

    def table(self, node: Node) -> str:
        rows = []

        def visit(n: Node, header: bool) -> None:
            for c in n.content:
                if not isinstance(c, Node):
                    continue
                if c.tag in ("tr", "row"):
                    cells = [xml("cell", self.inline(x).strip()) for x in c.content if isinstance(x, Node) and x.tag in ("td", "th", "cell")]
                    head = header or any(isinstance(x, Node) and x.tag == "th" for x in c.content)
                    rows.append(xml("row", "".join(cells), role="header" if head else None))
                else:
                    visit(c, header or c.tag == "thead")

        visit(node, False)
        self.handled.add("table")
        return xml("table", "".join(rows))

    def listing(self, node: Node) -> str:
        self.handled.add(node.tag)
        return xml("list", "".join(xml("item", self.inline(c).strip()) for c in node.content if isinstance(c, Node) and c.tag in ("li", "item")))

    def div(self, node: Node) -> str:
        """The first class is the type, else section; the first heading is the head, else the title-cased type."""
        self.handled.add("div")
        kind = (node.attrs.get("class", "").split() or [node.attrs.get("type", "section")])[0]
        heads = [c for c in node.content if isinstance(c, Node) and c.tag in HEADS]
        title = self.inline(heads[0]).strip() if heads else escape(kind.title())
        rest = Node("", {}, [c for c in node.content if not heads or c is not heads[0]])
        return xml("div", xml("head", title) + self.blocks(rest), type=kind)

    def block(self, c: Node) -> str:
        if c.tag == "p":
            self.handled.add("p")
            if all(isinstance(x, Node) and x.tag == "p" or isinstance(x, str) and not x.strip() for x in c.content) and c.content:
                return self.blocks(c)
            inner = self.inline(c).strip()
            blank = "<lb/>" if c.attrs.get("rend") == "standard-leerzeile" else ""
            return blank + xml("p", inner) if inner else blank
        if c.tag in HEADS:
            self.handled.add(c.tag)
            return xml("head", self.inline(c).strip())
        if c.tag == "div":
            return self.div(c)
        if c.tag == "table":
            return self.table(c)
        if c.tag in ("ul", "ol", "list"):
            return self.listing(c)
        if c.tag in ("graphic", "img", "svg"):
            return self.graphic(c)
        if c.tag in ("lb", "br"):
            self.handled.add(c.tag)
            return "<lb/>"
        return xml("p", self.inline(Node("", {}, [c])).strip())

    def blocks(self, node: Node) -> str:
        out, loose = [], []

        def flush() -> None:
            inner = self.inline(Node("", {}, list(loose))).strip()
            loose.clear()
            if inner:
                out.append(xml("p", inner))

        for c in node.content:
            if isinstance(c, str) or c.tag in INLINE or c.tag in ("hi", "span", "a", "ref"):
                loose.append(c)
            else:
                flush()
                out.append(self.block(c))
        flush()
        return "".join(out)

    def fragment(self, text: str, kind: str | None = None) -> str:
        """A fragment's blocks. A chapter's first paragraph with text is its head; a table of contents is a list."""
        root = parse(text)
        if kind == "toc":
            entries = [t for t in (html_text(_serialise(c)) for c in root.content if isinstance(c, Node) and c.tag in ("p", "item", "li")) if t]
            if entries:
                return xml("list", "".join(xml("item", escape(t)) for t in entries))
        if kind == "chapter":
            for k, c in enumerate(root.content):
                if isinstance(c, Node) and c.tag == "p" and (title := c.text().strip()):
                    before = Node("", {}, root.content[:k])
                    return xml("head", escape(title)) + self.blocks(before) + self.blocks(Node("", {}, root.content[k + 1 :]))
        return self.blocks(root)


def _serialise(node: Node) -> str:
    inner = "".join(escape(c) if isinstance(c, str) else _serialise(c) for c in node.content)
    return f"<{node.tag}>{inner}</{node.tag}>" if node.tag else inner


#: Renditions with a meaning in the second converter's source.
ITALIC_REND, PARAGRAPH_REND = "class1752", "class-0"


def convert_divs(text: str, italic: str = ITALIC_REND, paragraph: str = PARAGRAPH_REND) -> str:
    """The second converter: every div, nested ones too, is a TEI div with its class as type; empty ones are dropped.

    p.title is a head, hi with the rendition `italic` within a paragraph is italic and with `paragraph` beside
    paragraphs is one; graphics and breaks are kept with their attributes. Other elements stay as they are, but for
    nested divs, which follow as divs of their own.
    """
    out = []

    def inline(p: Node) -> str:
        parts = []
        for x in p.content:
            if isinstance(x, str):
                parts.append(escape(x))
            elif x.tag == "hi" and x.attrs.get("rend") == italic:
                parts.append(xml("hi", inline(x), rend="italic"))
            else:
                parts.append(xml(x.tag, inline(x), **x.attrs))
        return "".join(parts)

    def visit(node: Node) -> None:
        for x in node.content:
            if not isinstance(x, Node):
                continue
            if x.tag == "div":
                parts = []
                for c in x.content:
                    if not isinstance(c, Node) or c.tag == "div":
                        continue
                    if c.tag == "p" and c.attrs.get("class") == "title":
                        parts.append(xml("head", escape(c.text().strip())))
                    elif c.tag == "p":
                        parts.append(xml("p", inline(c).strip()))
                    elif c.tag == "hi" and c.attrs.get("rend") == paragraph:
                        parts.append(xml("p", escape(c.text().strip())))
                    elif c.tag in ("graphic", "lb"):
                        parts.append(xml(c.tag, **c.attrs))
                    else:
                        parts.append(xml(c.tag, escape(c.text().strip()), **c.attrs))
                if parts:
                    out.append(xml("div", "".join(parts), type=x.attrs.get("class", "unknown")))
            visit(x)

    visit(parse(text))
    return "".join(out)


def _first(value) -> str:
    if isinstance(value, list):
        value = value[0] if value else None
    return "" if value is None else str(value)


def header(meta: dict, title: str | None) -> str:
    """teiHeader from metadata: title, first creator, publisher, first date, first urn:uuid identifier, language."""
    ids = meta.get("identifier") or []
    urn = next((i for i in (ids if isinstance(ids, list) else [ids]) if isinstance(i, str) and i.startswith("urn:uuid:")), "")
    name = _first(meta.get("title")) or title or ""
    date = _first(meta.get("date"))
    statement = xml("titleStmt", xml("title", escape(name)) + xml("author", escape(_first(meta.get("creator")))))
    publication = xml("publicationStmt", xml("publisher", escape(_first(meta.get("publisher")))) + xml("date", escape(date), when=date) + xml("idno", escape(urn), type="URN"))
    language = xml("langUsage", xml("language", ident=_first(meta.get("language"))))
    return xml("teiHeader", xml("fileDesc", statement + publication) + xml("profileDesc", language))


def route(kind: str | None, href: str | None, title: str | None = None, forewords: frozenset[str] = frozenset()) -> tuple[str, str] | None:
    """Where a node goes: (front or body, div type). None for a node without type. A node of unknown type is a cover
    or, if its title is one of the forewords', a foreword."""
    if not kind:
        return None
    k = kind.lower()
    if "chapter" in k:
        return "body", "chapter"
    if k in ("unkown", "unknown"):
        if (href or "").endswith("part0000.xhtml"):
            return "front", "cover"
        if title in forewords:
            return "front", "foreword"
    return "front", k


def book_to_tei(body: str, forewords: frozenset[str] = frozenset()) -> str | None:
    """TEI of a record; null if the body is no JSON object. Nodes follow in document order."""
    try:
        book = json.loads(body)
    except (ValueError, RecursionError):
        return None
    if not isinstance(book, dict):
        return None
    meta = book.get("epub_metadata")
    c, parts = Converter(), {"front": [], "body": []}
    entries = lambda content: reversed(content if isinstance(content, list) else [content] if isinstance(content, dict) else [])
    stack = list(entries(book.get("content")))
    while stack:
        node = stack.pop()
        if not isinstance(node, dict):
            continue
        place = route(node.get("inferred-type"), node.get("href"), node.get("title"), forewords)
        if place and isinstance(node.get("text"), str) and node["text"].strip():
            kind = "toc" if place[1] == "toc" else "chapter" if place[1] == "chapter" else None
            parts[place[0]].append(xml("div", c.fragment(node["text"], kind), type=place[1]))
        stack.extend(entries(node.get("content")))
    text = xml("text", xml("front", "".join(parts["front"])) + xml("body", "".join(parts["body"])))
    return f'<TEI xmlns="http://www.tei-c.org/ns/1.0">{header(meta if isinstance(meta, dict) else {}, _first(book.get("title")))}{text}</TEI>'


def book_to_html(body: str) -> str | None:
    """One HTML page of a record: a div per node with its type as class; a placeholder paragraph where text is missing."""
    try:
        book = json.loads(body)
    except (ValueError, RecursionError):
        return None
    if not isinstance(book, dict):
        return None
    out = []

    def visit(content) -> None:
        for node in content if isinstance(content, list) else [content] if isinstance(content, dict) else []:
            if isinstance(node, dict):
                kind = node.get("inferred-type") or ("section" if node.get("content") else "unknown")
                text = node.get("text")
                out.append(f'<div class="{escape(str(kind))}">{text if isinstance(text, str) and text.strip() else "<p>…</p>"}')
                visit(node.get("content"))
                out.append("</div>")

    visit(book.get("content"))
    return f"<html><head><title>{escape(_first(book.get('title')))}</title></head><body>{''.join(out)}</body></html>"


def _map_strings(convert: Callable[[str, str | None], str | None]):
    schema = pa.schema([("id", pa.string()), ("out", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds = b.column("kind").to_pylist()
            out = [None if t is None else convert(t, k) for t, k in zip(b.column("text").to_pylist(), kinds)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.string())], schema=schema)

    return run


def convert(fragments: DataFrame, id_col: str, text_col: str, kind_col: str | None = None, converter: str = "rules") -> DataFrame:
    """(id, tei) of each fragment; null stays null. Converters: rules, divs, book, page."""
    fn = {
        "rules": lambda t, k: Converter().fragment(t, "chapter" if k and "chapter" in k.lower() else k),
        "divs": lambda t, k: convert_divs(t), "book": lambda t, k: book_to_tei(t), "page": lambda t, k: book_to_html(t),
    }[converter]
    kind = F.col(kind_col) if kind_col else F.lit(None).cast("string")
    rows = fragments.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), kind.alias("kind"))
    return rows.mapInArrow(_map_strings(fn), "id string, out string").withColumnRenamed("out", "tei")


def coverage(fragments: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(tag, handled) over all fragments: which tags the rules cover."""
    schema = pa.schema([("tag", pa.string()), ("handled", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Converter()
        for b in batches:
            for t in b.column("text").to_pylist():
                c.fragment(t)
        rows = [(t, True) for t in c.handled] + [(t, False) for t in c.unhandled]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else ([], []), schema.types)], schema=schema)

    rows = fragments.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text")).mapInArrow(run, "tag string, handled boolean")
    return rows.groupBy("tag").agg(F.bool_or("handled").alias("handled"))


def strip_fence(answer: Column) -> Column:
    """A leading ```lang line and a trailing fence are taken off."""
    text = unicode_strip(answer)
    inner = F.regexp_replace(F.regexp_replace(text, r"\A```[a-zA-Z]*\n?", ""), r"\n?```\z", "")
    return unicode_strip(F.when(text.startswith("```"), inner).otherwise(text))


def second_fence(answer: Column) -> Column:
    """The first fenced block's body without a leading 'xml'; the answer itself without fences."""
    body = F.split_part(answer, F.lit("```"), F.lit(2))
    return unicode_strip(F.when(answer.contains("```"), F.regexp_replace(body, r"^xml\s*", "")).otherwise(answer))


def div_type(answer: Column) -> Column:
    kind = F.regexp_extract(answer, r"<div[^>]*\btype=\"([^\"]*)\"", 1)
    return F.when(kind == "", "unknown").otherwise(kind)


#: The opening tag by strategy.
OPENING = {"explicit_chapter": '<div type="chapter">', "implicit_chapter_stars": '<div type="chapter" rend="separator">', "implicit_chapter_jpg": '<div type="chapter" rend="image-separator">'}


def wrap(text: Column, strategy: Column, indent: str = "") -> Column:
    """The chapter in its div, each on lines of their own, the lines with text indented; other strategies raise."""
    opening = F.raise_error(F.concat(F.lit("no wrapping for strategy "), F.coalesce(strategy, F.lit("null"))))
    for name, tag in OPENING.items():
        opening = F.when(strategy == name, tag).otherwise(opening)
    inner = F.regexp_replace(text, r"(?mU)^(?=[^\n]*\S)", indent) if indent else text
    return F.concat(opening, F.lit("\n"), inner, F.lit("\n</div>"))


def quality_flags(text: Column, strategy: Column) -> tuple[Column, Column]:
    """(uncertain_found, unknown_type_found): the latter only outside of chapters."""
    return text.contains("<uncertain>"), text.contains('type="unknown"') & ~strategy.isin(*OPENING)


def front_first_strip_prefix(text: Column) -> Column:
    """Serialiser prefixes like ns0: taken off tag names."""
    return F.regexp_replace(F.regexp_replace(text, r"<(/?)ns\d+:", "<$1"), r" xmlns:ns\d+=\"[^\"]*\"", "")




def prettify(text: str) -> str:
    """The fragment re-indented, one tag or text a line."""
    out: list[str] = []

    def visit(node: Node, depth: int) -> None:
        for c in node.content:
            if isinstance(c, str):
                if c.strip():
                    out.append(" " * depth + escape(c.strip()))
            else:
                attrs = "".join(f" {k}={quoteattr(v)}" for k, v in c.attrs.items())
                if c.content:
                    out.append(f"{' ' * depth}<{c.tag}{attrs}>")
                    visit(c, depth + 1)
                    out.append(f"{' ' * depth}</{c.tag}>")
                else:
                    out.append(f"{' ' * depth}<{c.tag}{attrs}/>")

    visit(parse(text), 0)
    return "\n".join(out)


def volumes(body: str) -> list[tuple[str, str]]:
    """(file name, HTML) of a collection: 00_main_info for loose entries, NN_<title> for each section."""
    import re

    try:
        book = json.loads(body)
    except (ValueError, RecursionError):
        return []
    content = book.get("content") if isinstance(book, dict) else None
    entries = [e for e in content if isinstance(e, dict)] if isinstance(content, list) else []
    sections = [e for e in entries if e.get("type") == "Section"]
    loose = [e for e in entries if e.get("type") != "Section"]
    page = lambda title, nodes: book_to_html(json.dumps({"title": title, "content": nodes}))
    out = [("00_main_info.html", page(book.get("title"), loose))] if loose else []
    for k, s in enumerate(sections, 1):
        safe = re.sub(r"[^\w \-]", "", str(s.get("title") or "")).rstrip()
        out.append((f"{k:02d}_{safe}.html", page(s.get("title"), s.get("content"))))
    return out


def book_volumes(book_json: DataFrame) -> DataFrame:
    """(record_id, name, html) of every volume."""
    schema = pa.schema([("record_id", pa.int64()), ("name", pa.string()), ("html", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, n, h) for i, t in zip(b.column("record_id").to_pylist(), b.column("body").to_pylist()) if t for n, h in volumes(t)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ([], [], []), schema.types)], schema=schema)

    return book_json.select(F.col("record_id").cast("long").alias("record_id"), "body").mapInArrow(run, "record_id bigint, name string, html string")
