import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quire.operators import evaluation as E
from quire.operators import labels as L


def brute(pairs):
    """Metrics from plain Python: (accuracy, macro f1, weighted f1) over gold and predicted labels."""
    labels = {x for p in pairs for x in p}
    f1, support = {}, Counter(g for g, _ in pairs)
    for x in labels:
        tp = sum(g == p == x for g, p in pairs)
        f1[x] = 2 * tp / (support[x] + sum(p == x for _, p in pairs))
    return sum(g == p for g, p in pairs) / len(pairs), sum(f1.values()) / len(labels), sum(f1[x] * support[x] for x in labels) / len(pairs)


def test_metrics_against_brute_force(spark):
    rng = random.Random(3)
    pairs = [(rng.choice("abc"), rng.choice("abcd")) for _ in range(300)]
    rows = [(str(i), f" {g.upper()} ", p) for i, (g, p) in enumerate(pairs)]
    rng.shuffle(rows)
    df = spark.createDataFrame([*rows, rows[0], ("n", None, "a"), ("m", "a", None), ("e", "a", "")], "id string, gold_label string, `m-1.0` string")
    r = E.summary(E.long_results(df, ["m-1.0"])).first()
    assert r["samples"] == 300
    for got, want in zip((r["accuracy"], r["macro_f1"], r["weighted_f1"]), brute(pairs)):
        assert abs(got - want) < 1e-12
    with_nan = E.summary(E.long_results(df, ["m-1.0"], gold_null_as_label=True)).first()
    assert with_nan["samples"] == 301
    cells = {(c["gold"], c["pred"]): c["n"] for c in E.confusion(E.long_results(df, ["m-1.0"])).collect()}
    assert len(cells) == 16 and cells == {(g, p): Counter(pairs)[g, p] for g, p in itertools.product("abcd", repeat=2)}
    rel = {(c["gold"], c["pred"]): c["share"] for c in E.confusion_relative(E.confusion(E.long_results(df, ["m-1.0"])), compat=True).collect()}
    assert rel["d", "a"] == 1.0 and abs(sum(rel["a", p] for p in "abcd") - 1) < 1e-6
    assert E.min_support(E.long_results(df, ["m-1.0"]), 1000).count() == 0


def test_known_report(spark):
    rows = [("1", "toc", "toc"), ("2", "toc", "imprint"), ("3", "imprint", "imprint"), ("4", "chapter", "unknown")]
    got = {r["label"]: r for r in E.report_frame(E.long_results(spark.createDataFrame(rows, "id string, gold_label string, m string"), ["m"]), 6).collect()}
    assert (got["toc"]["precision"], got["toc"]["recall"], got["toc"]["f1"], got["toc"]["support"]) == (1.0, 0.5, 0.666667, 2.0)
    assert got["unknown"]["support"] == 0 and got["unknown"]["f1"] == 0 and got["accuracy"]["f1"] == 0.5
    assert got["macro avg"]["f1"] == round((2 / 3 + 2 / 3 + 0 + 0) / 4, 6)


@pytest.mark.parametrize(("answer", "last", "want"), [
    ('{"label":"toc"}', False, "toc"), ('```json\n{"label": "toc"}\n```', False, "toc"), ('Sure: {"label":"toc"} done', False, "toc"), ('{"label":"a"} or {"label":"toc"}', True, "toc"),
    ('{"label":"to', False, None), ("", False, None), (None, False, None), ("no json", True, None), ('text ```\n{"label":"toc"}\n``` text', False, "toc"),
    ('```\nnichts\n``` dann ```json\n{"label":"toc"}\n```', False, "toc"), ('a {"label":"x"} ```json {"label":"toc"}``` {', False, "toc"), ('{"label":"a"} ```kein json``` {"label":"toc"}', True, "a"),
])
def test_json_answers(spark, answer, last, want):
    df = spark.createDataFrame([(answer,)], "a string").select(F.get_json_object(L.json_answer(F.col("a"), last), "$.label").alias("l"))
    assert df.first()["l"] == want


def test_ids(spark):
    df = spark.createDataFrame([("b.json_0_1",), ("a_b.json_12_3_Name",), ("x",), (None,)], "id string")
    got = [tuple(r) for r in df.select(*L.parse_chunk_id(F.col("id"))).collect()]
    assert got == [("b.json", 0, 1, "b.json"), (None, None, None, "a_b.json"), (None, None, None, None), (None, None, None, None)]


def test_joins(spark):
    chunks = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "id string")
    gold = spark.createDataFrame([("a", "toc"), ("b", ""), ("z", "toc")], "id string, gold_label string")
    assert {tuple(r) for r in L.join_status(chunks, gold).collect()} == {("a", "toc", "OK"), ("b", None, "MISSING"), ("c", None, "MISSING")}
    assert tuple(L.labelled_hits(chunks, gold).first()) == (3, 2, 1)
    rows = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 1)], "id string, label string, o int")
    assert {tuple(r) for r in L.last_wins(rows, "id", "label", ["o"]).collect()} == {("a", "y"), ("b", "x")}
    assert L.append_new(gold, chunks.distinct()).count() == 4
    wide = spark.createDataFrame([("a", "x", None), ("b", None, None)], "id string, `m/1` string, m2 string")
    assert {tuple(r) for r in L.remaining(wide, ["m/1", "m2"]).collect()} == {("m/1", 1, 1), ("m2", 0, 2)}
    assert L.insert_after(["id", "gold_label", "m"], "inferred_type", "gold_label") == ["id", "gold_label", "inferred_type", "m"] and L.insert_after(["id"], "x", "y") == ["id", "x"]
    assert L.drop_matching(spark.createDataFrame([(1, 2)], "m int, m_subtype int"), "subtype").columns == ["m"]


def test_validation(spark):
    df = spark.createDataFrame([("toc", "editorial"), ("reader-information", "editorial"), ("reader-information", "x"), ("tocc", None), (None, None), ("reader-information", None)], "l string, s string")
    label, subtype = L.validate(F.col("l"), F.col("s"))
    assert [tuple(r) for r in df.select(label, subtype, L.subtype_rule(F.col("l"), F.col("s"))).collect()] == [
        ("toc", None, "none"), ("reader-information", "editorial", "editorial"), ("reader-information", None, "x"), ("unknown", None, "none"), ("unknown", None, "none"), ("reader-information", None, "none")]


def test_failed_text_and_first(spark):
    res = spark.createDataFrame([("a", " Batch_error"), ("a", "batch_error"), ("b", "toc"), ("c", "parsing_error"), ("d", "too_long"), ("e", None)], "id string, m string")
    assert {tuple(r) for r in L.failed_ids(res, "m").collect()} == {("a", "batch_error"), ("c", "parsing_error")}
    chunks = spark.createDataFrame([("a", "t"), ("a", "t"), ("b", " "), (None, "x")], "id string, text string")
    assert {(r["id"], r["chunk_text"], r["no_text"]) for r in L.with_text(res.select("id").distinct(), chunks).collect()} == {("a", "t", False), ("b", " ", True), ("c", None, True), ("d", None, True), ("e", None, True)}
    todo = spark.createDataFrame([("x", str(k)) for k in range(5)] + [("y", "7")], "model string, id string")
    assert {tuple(r) for r in L.first_per_model(todo, 2).collect()} == {("x", "0"), ("x", "1"), ("y", "7")}


def test_one_row_of_differing_ones(spark):
    rows = [("1", "toc", None), ("1", None, "imprint"), ("1", "imprint", "toc")]
    df = spark.createDataFrame(rows, "id string, gold_label string, m string")
    for part in (1, 3):
        assert [(r["gold"], r["pred"]) for r in E.long_results(df.repartition(part), ["m"]).collect()] == []
    assert [(r["gold"], r["pred"]) for r in E.long_results(df.where("m IS NOT NULL"), ["m"]).collect()] == [("imprint", "toc")]
