"""HTML and TEI fragments as a relation of elements, by one lenient pass over each fragment.

Rules of the tree: names are lower-cased; nothing is implied (no html, body or closing p); an end tag
closes the nearest open element of its name and all within it, or is ignored; void elements and
self-closed tags hold nothing; comments, declarations and the bodies of script and style are skipped.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The void elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][\w:.\-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>", re.S)
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>`]+)))?")
_RAW = {"script": re.compile(r"</script\s*>", re.I), "style": re.compile(r"</style\s*>", re.I)}


def parse_attrs(source: str) -> dict[str, str]:
    """Attributes by lower-case name, the last of equal names holds; entities are decoded."""
    out = {}
    for name, a, b, c in _ATTR.findall(source):
        value = a or b or c
        out[name.lower()] = html.unescape(value) if "&" in value else value
    return out


def events(text: str) -> Iterator[tuple[str, str, object]]:
    """(kind, name or text, attributes source): kinds start, empty, end, text."""
    pos = 0
    while True:
        m = _TOKEN.search(text, pos)
        if m is None:
            break
        if m.start() > pos:
            yield "text", text[pos : m.start()], None
        pos = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            yield "end", tag, None
            continue
        attrs = m[3]
        closed = attrs.rstrip().endswith("/")
        yield ("empty" if closed or tag in VOID else "start"), tag, attrs.rstrip().rstrip("/") if closed else attrs
        if tag in _RAW and not closed:
            end = _RAW[tag].search(text, pos)
            pos = end.start() if end else len(text)
    if pos < len(text):
        yield "text", text[pos:], None


def elements_of(text: str) -> list[tuple]:
    """(el_ord, tag, parent_ord, parent_tag, depth, attrs, classes, nesting, text, prev, next) in document order.

    nesting, of an element that is in none of its own tag, is the longest chain of direct children of that tag from
    it on, itself included; null for all others. text is the element's own text without its children's; prev and next
    are the neighbouring siblings' tags.
    """
    out: list[list] = []
    stack: list[int] = []
    last_child: dict[int | None, int] = {}
    inside: dict[str, int] = {}  # open elements by tag
    chain: list[int] = []  # length of the chain of direct children up to each element, 0 if it doesn't reach the outermost
    outermost: list[int] = []
    for kind, name, attrs in events(text):
        if kind == "text":
            if stack and not name.isspace():
                out[stack[-1]][8] += html.unescape(name)
        elif kind == "end":
            if inside.get(name):
                while True:
                    gone = out[stack.pop()][1]
                    inside[gone] -= 1
                    if gone == name:
                        break
        else:
            parent = stack[-1] if stack else None
            parsed = parse_attrs(attrs) if attrs and not attrs.isspace() else {}
            prev = last_child.get(parent)
            if prev is not None:
                out[prev][10] = name
            n = len(out)
            parent_tag = out[parent][1] if parent is not None else None
            if not inside.get(name):
                chain.append(1)
                outermost.append(n)
            elif parent_tag == name and chain[parent]:
                chain.append(chain[parent] + 1)
                outermost.append(outermost[parent])
                out[outermost[n]][7] = max(out[outermost[n]][7], chain[n])
            else:
                chain.append(0)
                outermost.append(n)
            out.append([n, name, parent, parent_tag, len(stack) + 1, parsed, parsed.get("class", "").split(), 1 if not inside.get(name) else None, "", out[prev][1] if prev is not None else None, None])
            last_child[parent] = n
            if kind == "start":
                stack.append(n)
                inside[name] = inside.get(name, 0) + 1
    return [tuple(r) for r in out]


_ELEMENT = pa.schema([
    ("doc_id", pa.string()), ("frag_id", pa.string()), ("el_ord", pa.int64()), ("tag", pa.string()), ("parent_ord", pa.int64()), ("parent_tag", pa.string()), ("depth", pa.int64()),
    ("attrs", pa.map_(pa.string(), pa.string())), ("classes", pa.list_(pa.string())), ("nesting", pa.int64()), ("text", pa.string()), ("prev_tag", pa.string()), ("next_tag", pa.string()),
])
ELEMENT_DDL = "doc_id string, frag_id string, el_ord bigint, tag string, parent_ord bigint, parent_tag string, depth bigint, attrs map<string,string>, classes array<string>, nesting bigint, text string, prev_tag string, next_tag string"


def _shred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for doc, frag, text in zip(*(b.column(k).to_pylist() for k in ("doc_id", "frag_id", "text"))):
            for e in elements_of(text):
                rows.append((doc, frag, *e[:5], list(e[5].items()), *e[6:]))
            if len(rows) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ELEMENT.types)], schema=_ELEMENT)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ELEMENT.types)], schema=_ELEMENT)


def elements(fragments: DataFrame, doc: str, frag: str, text: str) -> DataFrame:
    """One row per element of each fragment with non-blank text; map-only, no shuffle."""
    rows = fragments.select(F.col(doc).cast("string").alias("doc_id"), F.col(frag).cast("string").alias("frag_id"), F.col(text).alias("text"))
    return rows.where(F.col("text").contains("<")).mapInArrow(_shred, ELEMENT_DDL)


def html_text(text: str | None) -> str | None:
    """Visible text: text nodes stripped and joined by blanks, as get_text(separator=' ', strip=True) gives it."""
    if text is None:
        return None
    parts = (html.unescape(name).strip() for kind, name, _ in events(text) if kind == "text")
    return " ".join(p for p in parts if p)


# ---- open tags without leaving the JVM -----------------------------------------------------

#: What is no markup is taken out first, with the same patterns in both engines.
COMMENTS = r"(?s)<!--.*?-->"
RAW_BODIES = r"(?is)(<(?:script|style)\b[^>]*>).*?</(?:script|style)\s*>"
OPEN_TAG = r"<([a-zA-Z][a-zA-Z0-9]*)([^<>]*)>"


def open_tags(fragments: DataFrame, doc: str, frag: str, text: str) -> DataFrame:
    """(doc_id, frag_id, pos, tag, attrs) of every opening tag, by native expressions only."""
    clean = F.regexp_replace(F.regexp_replace(F.col(text), COMMENTS, ""), RAW_BODIES, "$1")
    rows = fragments.where(F.col(text).contains("<")).select(F.col(doc).alias("doc_id"), F.col(frag).alias("frag_id"), F.posexplode(F.regexp_extract_all(clean, F.lit(OPEN_TAG), F.lit(0))).alias("pos", "token"))
    return rows.select("doc_id", "frag_id", "pos", F.lower(F.regexp_extract("token", OPEN_TAG, 1)).alias("tag"), F.regexp_extract("token", OPEN_TAG, 2).alias("attrs"))


ATTRIBUTE = r"([a-zA-Z_:][a-zA-Z0-9_:.\-]*)=\"([^\"]*)\""


def attributes(tags: DataFrame) -> DataFrame:
    """(doc_id, frag_id, tag, name, value) of the quoted attributes of open tags."""
    rows = tags.select("doc_id", "frag_id", "tag", F.explode(F.regexp_extract_all("attrs", F.lit(ATTRIBUTE), F.lit(0))).alias("pair"))
    return rows.select("doc_id", "frag_id", "tag", F.lower(F.regexp_extract("pair", ATTRIBUTE, 1)).alias("name"), F.regexp_extract("pair", ATTRIBUTE, 2).alias("value"))
