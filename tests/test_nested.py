import json
import random

from quire.operators import nested, tree

DDL = "record_id long, source_file string, body string"


def brute(value, path="", parent=""):
    """(node_path, parent_path) by plain recursion."""
    content = value.get("content") if isinstance(value, dict) else None
    out = []
    for k, e in enumerate([content] if isinstance(content, dict) else content if isinstance(content, list) else []):
        if isinstance(e, dict):
            own = f"{path}/{k}" if path else str(k)
            out.append((own, path))
            out += brute(e, own)
    return out


def random_node(rng, depth):
    node = {"type": "EpubHtml", "text": rng.choice([None, "", "a", 5, ["x"]])}
    if depth and rng.random() < 0.6:
        inner = [rng.choice([None, "s", 3, [1], random_node(rng, depth - 1)]) for _ in range(rng.randrange(4))]
        node["content"] = rng.choice([inner, inner, random_node(rng, depth - 1), None, "x"])
    return node


def test_nodes_against_recursion(spark):
    rng = random.Random(7)
    rows = [(i, "f.json", json.dumps(random_node(rng, 5))) for i in range(200)]
    want = {(i, *n) for i, _, b in rows for n in brute(json.loads(b))}
    got = [tuple(r) for r in nested.find_nodes(spark.createDataFrame(rows, DDL)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


BOOK = {
    "title": "T", "source": "t.epub", "text": "wurzel",
    "processing_log": {"is_collection": True, "component_log": [{"step": "s", "added_fields": ["a", "b"]}, "x"]},
    "epub_metadata": {"title": ["T", "U"], "publisher": None, "date": [], "series": {"name": "S"}, "n": 3},
    "content": [{"type": "Section", "content": [{"type": "EpubHtml", "text": "eins", "inferred-type": "chapter", "images": ["i.jpg", "j.jpg"], "is_narrative": True, "x": 1}]}, "kein", {"type": "EpubHtml", "text": "  ", "images": "k.jpg", "is_narrative": "ja"}],
}


def test_tables(spark):
    df = spark.createDataFrame([(1, "00000001_a.json", json.dumps(BOOK)), (1, "00000001_a.json", json.dumps(BOOK)), (2, "b.json", "{"), (3, "c.json", None), (4, None, "[]"), (5, "e.json", '{"a": NaN}'), (6, "f.json", '{"title": "\\ud800"}')], DDL).selectExpr("*", "'z' AS key", "1 AS tag", "2 AS payload")
    t = {k: v.collect() for k, v in nested.shred(df).items()}
    assert sorted(r["record_id"] for r in t["reject"]) == [2, 3, 5]
    assert sorted(r["record_id"] for r in t["book"]) == [1, 1, 4, 6]
    assert {(r["name"], r["position"], r["kind"], r["value"]) for r in t["metadata"]} == {("title", 0, "array", "T"), ("title", 1, "array", "U"), ("series", 0, "object", '{"name": "S"}'), ("n", 0, "scalar", "3")}
    one = [r for r in t["node"] if r["key"] == "0/0"][0]
    assert (one["parent_key"], one["depth"], one["text"], one["is_narrative"], one["extra"], one["id_suffix"]) == ("0", 2, "eins", True, '{"x": 1}', "_01_01")
    assert [r["is_narrative"] for r in t["node"] if r["key"] == "2"] == [None, None]
    assert sorted({(r["parent_key"], r["position"], r["url"]) for r in t["image"]}) == [("0/0", 0, "i.jpg"), ("0/0", 1, "j.jpg"), ("2", 0, "k.jpg")]
    assert sorted({r["step"] or r["entry"] for r in t["log"]}) == ["s", "x"]
    assert {tuple(r["added_fields"]) for r in t["log"]} == {("a", "b"), ()}
    assert all(v.count() == 0 for v in nested.shred(df.limit(0)).values())


def test_very_deep_and_very_wide(spark):
    deep = {"text": "unten"}
    for _ in range(300):
        deep = {"content": [deep]}
    wide = {"content": [{"text": "x" * 2000}] * 3000}
    df = spark.createDataFrame([(1, "d.json", json.dumps(deep)), (2, "w.json", json.dumps(wide)), (3, "n.json", "[" * 200_000)], DDL)
    got = nested.find_nodes(df).groupBy("record_id").count().collect()
    assert {(r["record_id"], r["count"]) for r in got} == {(1, 300), (2, 3000)}


def test_walks_and_ids(spark):
    single = {"content": {"text": "a", "inferred-type": "novel", "content": [{"text": "b"}] * 101}}
    df = spark.createDataFrame([(1, "x.json", json.dumps(BOOK)), (2, "y.json", json.dumps(single))], DDL)
    ids = {(r["record_id"], r["node_path"]): r["base_id"] for r in tree.flatten_with_ids(df).collect()}
    assert ids[1, ""] == "x" and ids[1, "0/0"] == "x_01_01" and (1, "2") not in ids
    assert ids[2, "0"] == "y" and ids[2, "0/0"] == "y_01" and ids[2, "0/100"] == "y_101"
    assert {r["node_path"] for r in tree.walk(df.where("record_id = 1"), "content").collect()} == {"", "0/0", "2"}
    assert {r["node_path"] for r in tree.walk(df.where("record_id = 1"), "top").collect()} == {"2"}
    assert tree.walk(df.where("record_id = 2"), "lists").count() == 101
    assert {r["chunk_id"] for r in tree.collection_chunks(df.where("record_id = 1")).collect()} == {"x.json_1_0"}
