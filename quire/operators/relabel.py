"""Labels written back into book records, and types looked up by chunk id."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.labels import parse_chunk_id
from quire.operators.nested import emit_tagged, parse_body, table_of
from quire.plans.runtime import cut, join_checked


def insert_key(node: dict, key: str, value, after: str | None) -> dict:
    """The object with the key right after `after`; at the end where that is absent, in place where the key exists.

    With after=None the key is set: in place or at the end. Key order is kept.
    """
    if key in node or after is None or after not in node:
        return {**node, key: value}
    out = {}
    for k, v in node.items():
        out[k] = v
        if k == after:
            out[key] = value
    return out


def chunk_nodes(book: dict) -> Iterator[tuple[list, int, int, int]]:
    """(list, index, book number, chunk number) of the nodes that have a chunk id.

    A single book's entries are book 0. In a collection an entry with a list of its own is a book, numbered from 1
    in order of such entries; loose entries are book 0 with a count of their own.
    """
    content = book.get("content")
    if not isinstance(content, list):
        return
    log = book.get("processing_log")
    if not (isinstance(log, dict) and log.get("is_collection") is True):
        yield from ((content, k, 0, k) for k, e in enumerate(content) if isinstance(e, dict))
        return
    number, loose = 0, 0
    for k, e in enumerate(content):
        if not isinstance(e, dict):
            continue
        if isinstance(e.get("content"), list):
            number += 1
            yield from ((e["content"], c, number, c) for c, x in enumerate(e["content"]) if isinstance(x, dict))
        else:
            yield content, k, 0, loose
            loose += 1


_OUT = pa.schema([("record_id", pa.int64()), ("source_file", pa.string()), ("body", pa.string()), ("n_labelled", pa.int64()), ("n_missing", pa.int64())])


def _writer(key: str, after: str | None, missing: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for record, file, body, labels in zip(*(b.column(k).to_pylist() for k in ("record_id", "source_file", "body", "labels"))):
                try:
                    book = parse_body(body)
                except ValueError:
                    continue
                known, hit, miss = dict(labels or ()), 0, 0
                for holder, k, number, chunk in list(chunk_nodes(book)) if isinstance(book, dict) else ():
                    label = known.get(f"{file}_{number}_{chunk}")
                    hit, miss = hit + bool(label), miss + (not label)
                    holder[k] = insert_key(holder[k], key, label or missing, after)
                rows.append((record, file, json.dumps(book, ensure_ascii=False).encode("utf-8", "replace").decode(), hit, miss))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ([],) * 5, _OUT.types)], schema=_OUT)

    return run


def label_books(book_json: DataFrame, labels: DataFrame, key: str = "true-type", after: str | None = "inferred-type", missing: str = "none") -> DataFrame:
    """(record_id, source_file, body, n_labelled, n_missing): records with their chunks' labels in the JSON, key order kept.

    labels has id (<file>_<book>_<chunk>, suffixes ignored) and label; of equal ids the greatest label holds. Records
    whose body is no JSON are left out. A book's labels travel as one map; a book is one JSON value as it is.
    """
    token = r"^(.*?\.json)_(\d+)_(\d+)(?:_.*)?$"
    one = labels.where(F.col("id").rlike(token) & F.col("label").isNotNull()).select(F.regexp_extract("id", token, 1).alias("source_file"), F.concat_ws("_", F.regexp_extract("id", token, 1), F.regexp_extract("id", token, 2), F.regexp_extract("id", token, 3)).alias("k"), "label")
    one = one.groupBy("source_file", "k").agg(F.max("label").alias("label"))
    maps = one.groupBy("source_file").agg(F.map_from_entries(F.collect_list(F.struct("k", "label"))).alias("labels"))
    books = book_json.where("body IS NOT NULL").select(F.col("record_id").cast("long").alias("record_id"), "source_file", "body")
    rows = join_checked(books, cut(maps, "maps"), ["source_file"], "left")
    return rows.select("record_id", "source_file", "body", "labels").mapInArrow(_writer(key, after, missing), "record_id bigint, source_file string, body string, n_labelled bigint, n_missing bigint")


def lookup_types(ids: DataFrame, book_json: DataFrame) -> DataFrame:
    """(id, inferred_type, problem) by the position an id names: entry <chunk>, or entry <book> - 1 and in it <chunk>.

    Problems: 'bad id', 'no file', 'no position'. Of records delivered again the greatest record_id holds.
    """
    file, book, chunk, _ = parse_chunk_id(F.col("id"))
    wanted = ids.select("id").distinct().select("id", file.alias("source_file"), F.when(book == 0, chunk.cast("string")).otherwise(F.concat((book - 1).cast("string"), F.lit("/"), chunk.cast("string"))).alias("key"))
    tagged = emit_tagged(book_json, "node", "book")
    newest = table_of(tagged, "book").groupBy("source_file").agg(F.max("record_id").alias("record_id"))
    nodes = table_of(tagged, "node").select("record_id", "key", "inferred_type", F.lit(True).alias("there"))
    out = wanted.join(newest, "source_file", "left").join(nodes, ["record_id", "key"], "left")
    problem = F.when(F.col("source_file").isNull(), "bad id").when(F.col("record_id").isNull(), "no file").when(F.col("there").isNull(), "no position")
    return out.select("id", "inferred_type", problem.alias("problem"))
