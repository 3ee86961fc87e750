import random
from collections import Counter
from datetime import datetime

import pytest

from quire.llm import consensus as C

VOTES = "id string, labeller string, label string"
LABELS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(1)
    truth = {f"i{k}": rng.choice(LABELS) for k in range(300)}
    care = {f"w{k}": 0.9 for k in range(6)} | {"bad1": 0.2, "bad2": 0.2, "flip": 0.0}
    votes = []
    for i, t in truth.items():
        for w in rng.sample(sorted(care), 6):
            right = rng.random() < care[w]
            wrong = LABELS[(LABELS.index(t) + 1) % 3] if w == "flip" else rng.choice([x for x in LABELS if x != t])
            votes.append((i, w, t if right else wrong))
    return truth, care, votes, spark.createDataFrame(votes, VOTES), spark.createDataFrame([(x,) for x in LABELS], "label string")


def test_reliability_and_consensus(world):
    truth, care, votes, df, labels = world
    fitted, names = C.fit_consensus(df, labels)
    got = {r["labeller"]: r for r in C.reliability(fitted, names).collect()}
    assert {w for w, r in got.items() if r["reliable"]} == {w for w, c in care.items() if c > 0.5}
    for w, c in care.items():
        own = [v for v in votes if v[1] == w]
        assert abs(got[w]["accuracy"] - sum(truth[i] == x for i, _, x in own) / len(own)) < 0.08
    good = {w for w, c in care.items() if c > 0.5}
    for r in C.consensus(df, labels).collect():
        counts = Counter(x for i, w, x in votes if i == r["id"] and w in good).most_common()
        assert counts[0][1] == Counter(dict(counts))[r["consensus_label"]]
        assert r["n_votes"] == 6


def test_joined_matrices_agree(world):
    _, _, _, df, labels = world
    one = {r["id"]: r["consensus_label"] for r in C.consensus(df, labels).collect()}
    fitted, names = C.fit_consensus(df, labels, matrix_bytes=1)
    small, _ = C.fit_consensus(df, labels)
    a = {r["id"]: r["posterior"] for r in small.collect()}
    b = {r["id"]: r["posterior"] for r in fitted.collect()}
    assert a.keys() == b.keys() == one.keys()
    assert max(abs(x - y) for i in a for x, y in zip(a[i], b[i])) < 1e-9


def test_alpha(spark):
    labels = spark.createDataFrame([("a",), ("b",)], "label string")
    votes = [("1", "x", "a"), ("1", "y", "a"), ("2", "x", "a"), ("2", "y", "b"), ("3", "x", "b"), ("3", "y", "b"), ("4", "x", "b")]
    r = C.agreement(spark.createDataFrame(votes, VOTES), labels).first()
    # three items with two votes: one disagrees; labels a a a b b b
    assert r["n_items"] == 3 and abs(r["observed"] - 1 / 3) < 1e-12 and abs(r["alpha"] - (1 - (1 / 3) / (1 - 12 / 30))) < 1e-12


def test_latest_label_holds_and_spellings(spark):
    t = [datetime(2025, 1, k) for k in range(1, 5)]
    rows = [(1, "i", "a", "A", t[0]), (2, "i", " b ", "A", t[2]), (3, "i", None, "A", t[3]), (3, "i", None, "A", t[3]), (4, "i", "Title_page", "B", t[1]), (5, None, "a", "B", t[1]), (6, "i", "a", None, t[1])]
    df = spark.createDataFrame(rows, "annotation_id long, id string, gold_label string, annotator string, labelled_at timestamp")
    assert {tuple(r) for r in C.annotator_votes(df).collect()} == {("i", "A", "b"), ("i", "B", "title-page")}


def test_wrong_gold_and_edges(spark):
    results = [("i", "b", "a", "a", None), ("i", "b", "a", "a", None), ("j", None, "a", "a", "a"), ("k", "A ", "a", "a", "x"), ("l", "b", None, None, None)]
    names = "id string, gold_label string, openai_gpt_oss_120b string, deepseek_deepseek_v3_2 string, moonshotai_kimi_k2_0905 string, label string, labeller int"
    res = spark.createDataFrame([(*r, "x", 1) for r in results], names)
    ann = spark.createDataFrame([], "annotation_id long, id string, gold_label string, annotator string, labelled_at timestamp")
    labels = spark.createDataFrame([("a",), ("b",)], "label string")
    assert [tuple(r) for r in C.find_wrong_gold(res, ann, labels).collect()] == [("i", "a")]
    assert C.find_wrong_gold(res.limit(0), ann, labels).count() == 0
    assert C.find_wrong_gold(res, ann, labels.limit(0)).count() == 0
    assert C.agreement(C.all_votes(res.limit(0), ann), labels).first()["alpha"] is None
