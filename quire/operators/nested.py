"""Deeply nested book records as related flat tables, by single-pass tagged emission.

One depth-first visit of each record emits rows (tag, record_id, key, parent_key, position, payload)
for all tables at once. They are written once, partitioned by tag; a table is the rows of its tag with
its schema applied. Keys are paths in the record, so links need no shuffle to be made.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.plans.runtime import cut

#: Payload schema of each table; record_id, key, parent_key and position come before it.
SCHEMAS = {
    "book": "title string, source string, source_file string, is_collection boolean, n_nodes bigint, text string, meta_keys array<string>",
    "metadata": "name string, kind string, value string, nested boolean",
    "log": "step string, added_fields array<string>, entry string",
    "node": "depth bigint, type string, href string, title string, inferred_type string, true_type string, is_narrative boolean, text string, extra string, single boolean, id_suffix string",
    "image": "url string",
}
_NODE_KEYS = {"type", "href", "title", "inferred-type", "true-type", "is_narrative", "text", "images", "content"}


def _refuse(name: str):
    raise ValueError(name)


def parse_body(body: str | None):
    """Parsed JSON, or ValueError. NaN, Infinity and bodies nested beyond the parser's depth are not valid."""
    if body is None:
        raise ValueError("no body")
    try:
        return json.loads(body, parse_constant=_refuse)
    except RecursionError as e:
        raise ValueError("nested too deep") from e


def _string(value) -> str | None:
    """A scalar or nested value as a string: strings as they are, null as null, others as JSON."""
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False)


def _entries(value) -> list:
    """The entries of a content or value: an array's own, an object or scalar as the only one, none for null."""
    if isinstance(value, list):
        return value
    return [value] if value is not None else []


def visit(body: str, source_file: str | None) -> Iterator[tuple[str, str, str | None, int, dict]]:
    """(tag, key, parent_key, position, payload) of one record, depth first.

    Raises ValueError if the body is no JSON. A body that is JSON but no object has only a book row.
    """
    root = parse_body(body)
    n_nodes = 0
    if isinstance(root, dict):
        meta = root.get("epub_metadata")
        if isinstance(meta, dict):
            for name, value in meta.items():
                for pos, v in enumerate(_entries(value)):
                    kind = "array" if isinstance(value, list) else "object" if isinstance(value, dict) else "scalar"
                    yield "metadata", f"{name}/{pos}", "", pos, {"name": name, "kind": kind, "value": _string(v), "nested": isinstance(v, (dict, list))}
        log = root.get("processing_log")
        if isinstance(log, dict):
            for pos, e in enumerate(_entries(log.get("component_log"))):
                fields = e.get("added_fields") if isinstance(e, dict) else None
                payload = {"step": _string(e.get("step")) if isinstance(e, dict) else None, "added_fields": [_string(f) for f in _entries(fields)], "entry": _string(e)}
                yield "log", str(pos), "", pos, payload
        # a content that is an object is an array of one; entries that are no objects only count as positions
        content = root.get("content")
        stack: list[tuple] = []

        def push(content, prefix: str, parent: str, depth: int, suffix: str) -> None:
            if isinstance(content, (list, dict)):
                single = isinstance(content, dict)
                for k, e in reversed(list(enumerate(_entries(content)))):
                    if isinstance(e, dict):
                        stack.append((f"{prefix}{k}", parent, k, depth, e, single, suffix if single else f"{suffix}_{k + 1:02d}"))

        push(content, "", "", 1, "")
        while stack:
            path, parent, pos, depth, node, single, suffix = stack.pop()
            n_nodes += 1
            narrative = node.get("is_narrative")
            extra = {k: v for k, v in node.items() if k not in _NODE_KEYS}
            yield "node", path, parent, pos, {
                "depth": depth, "type": _string(node.get("type")), "href": _string(node.get("href")), "title": _string(node.get("title")),
                "inferred_type": _string(node.get("inferred-type")), "true_type": _string(node.get("true-type")),
                "is_narrative": narrative if isinstance(narrative, bool) else None, "text": _string(node.get("text")),
                "extra": _string(extra) if extra else None, "single": single, "id_suffix": suffix,
            }
            for k, image in enumerate(_entries(node.get("images"))):
                yield "image", f"{path}#{k}", path, k, {"url": _string(image)}
            push(node.get("content"), f"{path}/", path, depth + 1, suffix)
    get = root.get if isinstance(root, dict) else lambda k: None
    log = get("processing_log")
    collection = log.get("is_collection") if isinstance(log, dict) else None
    yield "book", "", None, 0, {
        "title": _string(get("title")), "source": _string(get("source")), "source_file": source_file,
        "is_collection": collection if isinstance(collection, bool) else None, "n_nodes": n_nodes, "text": _string(get("text")),
        "meta_keys": list(get("epub_metadata")) if isinstance(get("epub_metadata"), dict) else None,
    }


_EMIT = pa.schema([("tag", pa.string()), ("record_id", pa.int64()), ("key", pa.string()), ("parent_key", pa.string()), ("position", pa.int64()), ("payload", pa.string()), ("file", pa.string())])
_EMIT_DDL = "tag string, record_id bigint, key string, parent_key string, position bigint, payload string, file string"
#: Rows of one Arrow batch sent back, so that a batch of wide collections stays small.
_OUT_ROWS = 4096


def _emit(tags: frozenset[str] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _EMIT.types)], schema=_EMIT)

        def clean(s: str | None) -> str | None:  # lone surrogates have no UTF-8
            return s if s is None or s.isascii() else s.encode("utf-8", "replace").decode()

        rows: list[tuple] = []
        for b in batches:
            for record, name, body in zip(*(b.column(k).to_pylist() for k in ("record_id", "source_file", "body"))):
                try:
                    own = [(tag, record, clean(key), clean(parent), pos, clean(json.dumps(payload, ensure_ascii=False)), name) for tag, key, parent, pos, payload in visit(body, name) if tags is None or tag in tags]
                except ValueError:
                    own = [("reject", record, "", None, 0, None, name)] if tags is None or "reject" in tags else []
                rows.extend(own)
                if len(rows) >= _OUT_ROWS:
                    yield batch()
                    rows = []
        if rows:
            yield batch()

    return run


def emit_tagged(book_json: DataFrame, *tags: str) -> DataFrame:
    """All rows of all tables, or of those asked for, written once and partitioned by tag, each with its record's file.
    Bodies that are missing or no JSON have the tag 'reject'."""
    rows = book_json.select(F.col("record_id").cast("long").alias("record_id"), "source_file", "body").mapInArrow(_emit(frozenset(tags) if tags else None), _EMIT_DDL)
    return cut(rows.select("record_id", "key", "parent_key", "position", "payload", "file", "tag"), "tagged", partition_by=["tag"])


def table_of(tagged: DataFrame, tag: str, *more: str) -> DataFrame:
    """One table: record_id, key, parent_key, position, more columns of the emission, and the payload's columns."""
    rows = tagged.where(F.col("tag") == tag)
    if tag == "reject":
        return rows.select("record_id", *more)
    own = ["record_id", "key", "parent_key", "position", *more]
    return rows.select(*own, F.from_json("payload", SCHEMAS[tag]).alias("p")).select(*own, "p.*")


def shred(book_json: DataFrame, *tags: str) -> dict[str, DataFrame]:
    """The tables book, metadata, log, node, image and reject of the records, or those asked for.

    A record given again keeps its own record_id and rows. Missing, null and wrongly typed optional fields
    are null. An empty table gives empty tables. Extra columns of the input are not carried.
    """
    tagged = emit_tagged(book_json, *tags)
    return {tag: table_of(tagged, tag) for tag in tags or (*SCHEMAS, "reject")}


def find_nodes(book_json: DataFrame) -> DataFrame:
    """(record_id, node_path, parent_path) of all content nodes."""
    tagged = emit_tagged(book_json).where(F.col("tag") == "node")
    return tagged.select("record_id", F.col("key").alias("node_path"), F.col("parent_key").alias("parent_path"))
