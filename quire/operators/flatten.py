"""Any nested JSON records as related flat tables, by single-pass tagged emission.

One depth-first visit of each record emits a row (tag, pk, parent_pk, position, payload, kinds) for every object and
every entry of an array. They are written once, partitioned by tag; a table is the rows of its tag with the schema
that its fields' kinds give. Nothing about the records' format is assumed, and keys need no shuffle to be made:

* tag: the keys from the root to the object, joined by dots. A key that already occurs in the path leads back to its
  first occurrence, so recursive records fill one table however deep they are.
* pk: the record's key and the steps to the object, joined by '/', positions of array entries included; '~' and '/'
  in a key are written '~0' and '~1'.
* parent_pk: the pk of the enclosing object; position: the place in its array, 0 for an only object.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.nested import parse_body
from quire.plans.runtime import cut

ROOT = "root"
REJECTS = "rejects"
#: The field that holds an array's entry that is no object.
VALUE = "value"


def kind_of(value) -> str:
    """The column type of a scalar; a number beyond 64 bits is kept as a string."""
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "bigint" if -(1 << 63) <= value < 1 << 63 else "string"
    return "double" if isinstance(value, float) else "string"


def _tag(parent: str, key: str) -> str:
    """The table of an object below `parent`: recursion leads back to the key's first occurrence."""
    path = parent.split("\x1f")
    return "\x1f".join(path[: path.index(key) + 1] if key in path[1:] else [*path, key])


def visit(record, root: str = ROOT) -> Iterator[tuple[str, str, str | None, int, dict]]:
    """(tag, steps, parent_steps, position, scalar fields) of one parsed record, depth first and without recursion.

    A record that is no object has its value as the root's field `value`, an array its entries in the table `items`.
    Null fields, and empty objects and arrays, have no rows or fields of their own.
    """
    stack: list[tuple] = [(root, "", None, 0, record)]
    while stack:
        tag, steps, parent, position, value = stack.pop()
        fields, below = {}, []
        for key, v in value.items() if isinstance(value, dict) else [("items" if isinstance(value, list) else VALUE, value)]:
            if isinstance(v, dict) and v:
                below.append((_tag(tag, key), f"{steps}/{key.replace('~', '~0').replace('/', '~1')}", steps, 0, v))
            elif isinstance(v, list):
                step, child = f"{steps}/{key.replace('~', '~0').replace('/', '~1')}", _tag(tag, key)
                below.extend((child, f"{step}/{i}", steps, i, x) for i, x in enumerate(v))
            elif v is not None and not isinstance(v, dict):
                fields[key] = v
        yield tag.replace("\x1f", "."), steps, parent, position, fields
        stack.extend(reversed(below))


_ROWS = pa.schema([("tag", pa.string()), ("pk", pa.string()), ("parent_pk", pa.string()), ("position", pa.int64()), ("payload", pa.string()), ("kinds", pa.list_(pa.string()))])
_DDL = "tag string, pk string, parent_pk string, position bigint, payload string, kinds array<string>"
#: Rows of one Arrow batch sent back.
_OUT_ROWS = 4096


def _emit(root: str):
    def clean(s: str | None) -> str | None:  # lone surrogates have no UTF-8
        return s if s is None or s.isascii() else s.encode("utf-8", "replace").decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ROWS.types)], schema=_ROWS)

        for b in batches:
            for key, body in zip(b.column("k").to_pylist(), b.column("body").to_pylist()):
                key = "" if key is None else key
                try:
                    record = parse_body(body)
                except ValueError:
                    rows.append((REJECTS, key, None, 0, None, []))
                    continue
                for tag, steps, parent, position, fields in visit(record, root):
                    kinds = [clean(f"{kind_of(v)}:{name}") for name, v in fields.items()]
                    payload = json.dumps({n: v if kind_of(v) != "string" or isinstance(v, str) else str(v) for n, v in fields.items()}, ensure_ascii=False)
                    rows.append((clean(tag), clean(key + steps), None if parent is None else clean(key + parent), position, clean(payload), kinds))
                    if len(rows) >= _OUT_ROWS:
                        yield batch()
                        rows = []
        if rows:
            yield batch()

    return run


def emit(records: DataFrame, key: str, body: str, root: str = ROOT) -> DataFrame:
    """All rows of all tables of the records in the JSON column `body`, written once and partitioned by tag.

    Records whose body is null or no JSON have the tag 'rejects'. A key given again gives its rows again; a null key
    is the empty one. Other columns are not carried. An empty table gives no rows.
    """
    rows = records.select(F.col(key).cast("string").alias("k"), F.col(body).alias("body")).mapInArrow(_emit(root), _DDL)
    return cut(rows.select("pk", "parent_pk", "position", "payload", "kinds", "tag"), "flat", partition_by=["tag"])


def schema_of(emitted: DataFrame, tag: str) -> dict[str, str]:
    """Column type of each field of a table, by name: the one kind all values have, double for mixed numbers, else string."""
    rows = emitted.where(F.col("tag") == tag).select(F.explode("kinds").alias("k")).distinct()
    kinds: dict[str, set[str]] = {}
    for (k,) in rows.collect():  # a row per field and kind
        kind, name = k.split(":", 1)
        kinds.setdefault(name, set()).add(kind)
    return {n: next(iter(s)) if len(s) == 1 else "double" if s == {"bigint", "double"} else "string" for n, s in sorted(kinds.items())}


def _column(name: str, taken: set[str]) -> str:
    """A column name that no other has, whatever its case."""
    out = name or "_"
    while out.lower() in taken:
        out += "_"
    taken.add(out.lower())
    return out


def table(emitted: DataFrame, tag: str) -> DataFrame:
    """One table: pk, parent_pk, position and a column per field. A field whose name is taken gets '_' at its end."""
    schema = schema_of(emitted, tag)
    rows = emitted.where(F.col("tag") == tag).select("pk", "parent_pk", "position", F.from_json("payload", "map<string,string>").alias("p"))
    taken = {"pk", "parent_pk", "position"}
    return rows.select("pk", "parent_pk", "position", *(F.try_element_at("p", F.lit(n)).cast(kind).alias(_column(n, taken)) for n, kind in schema.items()))


def tables(records: DataFrame, key: str, body: str, root: str = ROOT) -> dict[str, DataFrame]:
    """Every table of the records by tag."""
    emitted = emit(records, key, body, root)
    return {r["tag"]: table(emitted, r["tag"]) for r in emitted.select("tag").distinct().collect()}


def describe(emitted: DataFrame) -> DataFrame:
    """(tag, field, n, example) of every field of every table: how often it has a value, and the least of the values'
    first 80 characters."""
    rows = emitted.where(F.col("payload").isNotNull()).select("tag", F.explode(F.from_json("payload", "map<string,string>")).alias("field", "value"))
    return rows.groupBy("tag", "field").agg(F.count("*").alias("n"), F.min(F.left("value", F.lit(80))).alias("example"))
