import json

from hypothesis import given, settings
from hypothesis import strategies as st

from quire.operators import flatten as X

DDL = "id string, body string"


def test_recursive_records_fill_one_table(spark):
    body = {"title": "T", "n": 3, "meta": {"author": ["A", {"name": "B"}], "empty": {}, "none": None}, "content": [{"href": "a", "content": [{"href": "b", "n": 1}, 7, {"href": "c", "n": 2.5, "content": {"href": "d", "pk": True}}]}, []]}
    got = X.tables(spark.createDataFrame([("1", json.dumps(body))], DDL), "id", "body")
    assert set(got) == {"root", "root.meta", "root.meta.author", "root.content", "root.content.items"} - {"root.content.items"}
    rows = {r["pk"]: r for r in got["root.content"].collect()}
    assert set(rows) == {"1/content/0", "1/content/1", "1/content/0/content/0", "1/content/0/content/1", "1/content/0/content/2", "1/content/0/content/2/content"}
    assert rows["1/content/0/content/2"]["parent_pk"] == "1/content/0" and rows["1/content/0/content/2/content"]["parent_pk"] == "1/content/0/content/2"
    assert rows["1/content/0/content/1"]["value"] == 7 and rows["1/content/0/content/2"]["n"] == 2.5 and rows["1/content/0/content/2/content"]["pk_"] is True
    root = got["root"].first()
    assert (root["pk"], root["parent_pk"], root["title"], root["n"]) == ("1", None, "T", 3)
    authors = {r["pk"]: r for r in got["root.meta.author"].collect()}
    assert authors["1/meta/author/0"]["value"] == "A" and authors["1/meta/author/1"]["name"] == "B" and {r["parent_pk"] for r in authors.values()} == {"1/meta"}


def rebuilt(value):
    """What the tables keep: nulls and empty arrays and objects are gone."""
    if isinstance(value, dict):
        out = {k: rebuilt(v) for k, v in value.items() if v is not None and v != {} and v != []}
        return out
    return [rebuilt(v) for v in value] if isinstance(value, list) else value


def assembled(rows):
    """The record again, from the visited rows alone."""
    objects = {steps: dict(fields) for _, steps, _, _, fields in rows}
    root = objects[""]
    for _, steps, parent, _, _ in rows[1:]:
        inner = steps[len(parent) + 1 :].split("/")
        key, own = inner[0].replace("~1", "/").replace("~0", "~"), objects[steps]
        if len(inner) == 2:
            own = own["value"] if set(own) == {"value"} and steps in scalars else own
            objects[parent].setdefault(key, []).append(own)
        else:
            objects[parent][key] = own
    return root


scalars: set = set()
_KEYS = st.text("ab/~.", min_size=1, max_size=2)
_SCALAR = st.one_of(st.integers(-5, 5), st.text("xy", max_size=2), st.booleans())
_JSON = st.dictionaries(_KEYS, st.recursive(_SCALAR, lambda x: st.one_of(st.lists(st.one_of(_SCALAR, st.dictionaries(_KEYS, x, min_size=2, max_size=3)), max_size=3), st.dictionaries(_KEYS, x, max_size=3)), max_leaves=12), max_size=4)


@settings(max_examples=150, deadline=None)
@given(_JSON)
def test_visit_loses_nothing(record):
    rows = list(X.visit(record))
    scalars.clear()
    scalars.update(steps for _, steps, _, _, fields in rows if set(fields) == {"value"})
    assert len({steps for _, steps, *_ in rows}) == len(rows)
    assert assembled(rows) == rebuilt(record)


def test_edges(spark):
    rows = [("1", None), ("2", "{"), ("3", "[1, [2]]"), ("4", '"text"'), (None, '{"a": 1, "A": 2, "b": "\\ud800", "c": 99999999999999999999}'), ("6", "{}"), ("6", "{}"), ("7", "[" * 900 + "]" * 900), ("8", json.dumps({"t": "ä" * 300_000}))]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], DDL + ", tag string, pk int")
    got = X.tables(df, "id", "body")
    assert sorted(r["pk"] for r in got["rejects"].collect()) == ["1", "2"]
    root = {r["pk"]: r for r in got["root"].collect()}
    assert root["4"]["value"] == "text" and root[""]["A"] == 2 and root[""]["a_"] == 1 and root[""]["c"] == "99999999999999999999" and len(root["8"]["t"]) == 300_000
    assert got["root"].where("pk = '6'").count() == 2
    assert sorted(r["pk"] for r in got["root.items"].where("pk LIKE '3%'").collect()) == ["3/items/0", "3/items/1", "3/items/1/items/0"]
    assert X.tables(df.limit(0), "id", "body") == {}
