import json

from quire.functions.tokens import model_tokens
from quire.operators import relabel, tei, textstats


def test_key_order():
    assert list(relabel.insert_key({"a": 1, "inferred-type": 2, "z": 3}, "true-type", "x", "inferred-type")) == ["a", "inferred-type", "true-type", "z"]
    assert list(relabel.insert_key({"a": 1}, "t", "x", "inferred-type")) == ["a", "t"] and relabel.insert_key({"t": 1, "a": 2}, "t", "x", "a") == {"t": "x", "a": 2}


def test_labels_into_books(spark):
    flat = {"content": [{"inferred-type": "toc", "text": "a"}, "x", {"text": "b"}]}
    coll = {"processing_log": {"is_collection": True}, "content": [{"text": "lose"}, {"type": "Section", "content": [{"text": "c"}, {"text": "d"}]}, {"text": "lose 2"}]}
    books = spark.createDataFrame([(1, "f.json", json.dumps(flat)), (2, "g.json", json.dumps(coll)), (3, "h.json", "{"), (4, "i.json", None)], "record_id long, source_file string, body string")
    gold = spark.createDataFrame([("f.json_0_0", "imprint"), ("f.json_0_2_Name", "chapter"), ("g.json_1_1", "toc"), ("g.json_0_1", "feedback"), ("bad", "x"), (None, "x"), ("g.json_1_0", None)], "id string, label string")
    got = {r["record_id"]: r for r in relabel.label_books(books, gold).collect()}
    assert set(got) == {1, 2} and (got[1]["n_labelled"], got[1]["n_missing"]) == (2, 0) and (got[2]["n_labelled"], got[2]["n_missing"]) == (2, 2)
    one = json.loads(got[1]["body"])["content"]
    assert list(one[0].items()) == [("inferred-type", "toc"), ("true-type", "imprint"), ("text", "a")] and one[2]["true-type"] == "chapter"
    two = json.loads(got[2]["body"])["content"]
    assert [two[0]["true-type"], two[1]["content"][0]["true-type"], two[1]["content"][1]["true-type"], two[2]["true-type"]] == ["none", "none", "toc", "feedback"]


def test_lookup(spark):
    flat = {"content": [{"inferred-type": "toc"}, {"text": "b"}]}
    books = spark.createDataFrame([(1, "f.json", json.dumps(flat))], "record_id long, source_file string, body string")
    ids = spark.createDataFrame([("f.json_0_0",), ("f.json_0_1",), ("f.json_0_9",), ("g.json_0_0",), ("schlecht",)], "id string")
    got = {r["id"]: (r["inferred_type"], r["problem"]) for r in relabel.lookup_types(ids, books).collect()}
    assert got == {"f.json_0_0": ("toc", None), "f.json_0_1": (None, None), "f.json_0_9": (None, "no position"), "g.json_0_0": (None, "no file"), "schlecht": (None, "bad id")}


def test_volumes_and_prettify():
    book = {"title": "T", "content": [{"text": "<p>lose</p>", "inferred-type": "toc"}, {"type": "Section", "title": "A/B!", "content": [{"text": "x"}]}, {"type": "Section", "title": None}]}
    out = tei.volumes(json.dumps(book))
    assert [n for n, _ in out] == ["00_main_info.html", "01_AB.html", "02_.html"] and "lose" in out[0][1] and tei.volumes("{") == []
    assert tei.prettify("<p>a<b>c</b></p>") == "<p>\n a\n <b>\n  c\n </b>\n</p>"


def test_public_tokenizer(spark):
    import os

    path = "/opt/tokenizers/byte_bpe_50k.json"
    if not os.path.exists(path):
        return
    chunks = spark.createDataFrame([("a", "f", "<p>hello world</p>", "toc"), ("b", "f", "", None)], "id string, source_file string, text string, inferred_type string")
    got = {r["id"]: r for r in textstats.token_stats(chunks, tokens=model_tokens(path)).collect()}
    assert got["a"]["tokens_plain"] == 2 and got["a"]["tokens_markup"] > 2 and got["b"]["tokens_markup"] == 0
