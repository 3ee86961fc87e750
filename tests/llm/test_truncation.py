import random

import numpy as np

from quire.llm import truncation as T
from quire.plans.runtime import read_table

DDL = "doc_id long, text string, source string"
NAMES = ["Anna", "Bert", "Carla", "Dirk", "Emma"]
VERBS = ["fand", "suchte", "verlor", "öffnete", "rettete"]
ADJ = ["alte", "kleine", "graue", "stille", "helle"]
NOUNS = ["Brücke", "Laterne", "Mühle", "Karte", "Glocke", "Truhe", "Insel"]


def sentence(rng):
    return f"{rng.choice(NAMES)} {rng.choice(VERBS)} die {rng.choice(ADJ)} {rng.choice(NOUNS)} hinter der {rng.choice(ADJ)}n {rng.choice(NOUNS)}."


def text(rng, n=12):
    return "Die " + rng.choice(NOUNS) + "\n" + " ".join(sentence(rng) for _ in range(n))


def cases():
    rng = random.Random(4)
    rows, want = [], set()
    for i in range(200):
        rows.append((i, text(rng), "a"))
    k = 200
    for end in (lambda t: t[:-9], lambda t: t[:-9] + "…", lambda t: t[:-9] + "...", lambda t: t[:-9] + "�", lambda t: t[: t.rindex(" hinter")] + ",", lambda t: t[: t.rindex(" der ") + 4], lambda t: "<p>" + t[:-9] + "</p>", lambda t: t[:-9] + "\nBestellen Sie jetzt den Rundbrief des Verlags"):
        rows.append((k, end(text(rng)), "a"))
        want.add(k)
        k += 1
    for end in (lambda t: t[:-1] + " …", lambda t: t + "\n\n• Die Mühle\n• Die Karte", lambda t: "<p>" + t + "</p>", lambda t: t + "\n2019-33", lambda t: "»" + t + "«", lambda t: t + "\nBestellen Sie jetzt den Rundbrief des Verlags"):
        rows.append((k, end(text(rng)), "a"))
        k += 1
    rows += [(k + i, text(rng) + "\nBestellen Sie jetzt den Rundbrief des Verlags", "a") for i in range(10)]
    rows += [(k + 20 + i, text(rng) + "\n• Die Insel\n• Die Truhe\n\nEnde gut.", "a") for i in range(10)]
    return rows, want


def test_closing_words(spark):
    rows, want = cases()
    got = {r[0] for r in T.find_truncated(spark.createDataFrame(rows, DDL)).collect()}
    assert got == want


def test_alignment(spark):
    rng = random.Random(9)
    whole = text(rng, 40)
    cut = whole[: int(len(whole) * 0.93)]
    while not (cut[-1].isalpha() and whole[len(cut)].isalpha()):
        cut = cut[:-1]
    assert T.aligned_early(cut, whole) is True
    assert T.aligned_early(whole, whole + "\nNoch ein Absatz.") is False
    assert T.aligned_early(cut, text(random.Random(10), 40)) is None
    rows = [(1, cut, "a"), (2, whole, "b")] + [(10 + i, text(rng), "a") for i in range(60)]
    got = {r["item_id"]: r for r in T.judge(spark.createDataFrame(rows, DDL)).collect()}
    assert got[1]["near_copy"] and got[1]["aligned_early"] and got[1]["truncated"] and not got[2]["truncated"]


def test_alignment_needs_no_more_words():
    rng = random.Random(21)
    whole = text(rng, 40)
    cut = whole[: whole.rindex(" hinter") + 4]
    assert T.aligned_early(whole[:-4], whole) is True  # as many words as the whole text
    assert T.aligned_early(cut + "\nWeiter auf unserer neuen Seite im Netz", whole) is True
    assert T.aligned_early(whole + "\nWeiter auf unserer neuen Seite im Netz", whole) is False
    head, rest = cut.rsplit(" ", 6)[0], " ".join(cut.rsplit(" ", 6)[1:])
    assert T.aligned_early(head + "\n" + rest + "x ganz anders", whole) is False  # only broken into lines


def test_every_text_of_a_bucket_is_met(spark, monkeypatch):
    rng = random.Random(33)
    whole = text(rng, 40)
    cut = whole[: int(len(whole) * 0.93)]
    while not (cut[-1].isalpha() and whole[len(cut)].isalpha()):
        cut = cut[:-1]
    inner = text(rng, 40)[:-4]
    # each bucket's longest text begins like the cut one, but holds too little of it
    rows = [(1, cut, "a"), (2, whole, "b"), (3, cut, "c")] + [(100 + i, whole[: int(len(whole) * 0.65)] + "\n" + text(rng, 40), f"s{i}") for i in range(60)]
    rows += [(4, inner, "a"), (5, inner + "rsa.", "b")] + [(10 + i, text(rng), "a") for i in range(30)]
    df = spark.createDataFrame(rows, DDL)
    assert all(T.aligned_early(cut, t) is None for i, t, _ in rows if i >= 100)
    for most in (1000, 7):
        monkeypatch.setattr(T, "CLASS_TEXTS", most)
        got = {r["item_id"]: r for r in T.judge(df).collect()}
        for i in (1, 3, 4):
            assert got[i]["near_copy"] and got[i]["aligned_early"] and got[i]["truncated"], i
        assert not got[2]["truncated"]


def test_any_number_of_lines_behind_the_end(spark):
    rng = random.Random(12)
    site = [f"{a} Hinweise des Verlags zum {b} Rundbrief" for a in ("Bitte", "Noch", "Neue", "Alle") for b in ("ersten", "zweiten")]
    marks = ["</p>", "</div>", "</section>", "</article>", "</main>", "</body>", "</html>"]
    rows = [(i, text(rng), "a") for i in range(60)] + [(100 + i, text(rng) + "\n" + "\n".join(site), "b") for i in range(12)]
    rows += [(1000, text(rng)[:-9] + "\n" + "\n".join(marks), "a"), (1001, text(rng)[:-9] + "\n" + "\n".join(site), "a"), (1002, text(rng) + "\n" + "\n".join(marks), "a"), (1003, text(rng) + "\n" + "\n".join(site), "a")]
    got = {r[0] for r in T.find_truncated(spark.createDataFrame(rows, DDL)).collect()}
    assert got == {1000, 1001}


def test_copies_that_lost_most_of_the_text_are_met(spark):
    rng = random.Random(44)
    rows = [(i, text(rng), "a") for i in range(40)]
    for k in range(12):
        whole = text(rng, 40)
        words = whole.split(" ")
        # the last word is whole and often closes sentences: only the other copy shows the cut
        rows += [(100 + k, whole, "b"), (200 + k, " ".join(words[: 45 + 14 * k]), "c")]
    got = {r["item_id"]: r for r in T.judge(spark.createDataFrame(rows, DDL)).collect()}
    cut = [200 + k for k in range(12) if got[200 + k]["kind"] != "whole"]
    assert len(cut) > 6 and all(got[i]["near_copy"] and got[i]["aligned_early"] and got[i]["truncated"] for i in cut)
    assert not any(got[100 + k]["truncated"] for k in range(12))


def test_begun_words(spark):
    rng = random.Random(3)
    words = {"".join(rng.choice("abä") for _ in range(rng.randint(1, 6))) for _ in range(300)} | {"z"}
    asked = {"".join(rng.choice("abä") for _ in range(rng.randint(1, 5))) for _ in range(80)} | {"z", "zz", "0", "ä"}
    want = {u for u in asked if any(w.startswith(u) and w != u for w in words)}
    frame = lambda rows, name: spark.createDataFrame([(x,) for x in rows], f"{name} string")
    for tasks in ("1", "4", "23"):
        spark.conf.set("spark.sql.shuffle.partitions", tasks)
        got = [r[0] for r in T.begun_words(frame(sorted(words), "word"), frame([*asked, "ab"], "prefix")).collect()]
        assert len(got) == len(set(got)) and set(got) == want | ({"ab"} if any(w.startswith("ab") and w != "ab" for w in words) else set())
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert T.begun_words(frame([], "word"), frame(["a"], "prefix")).count() == 0 and T.begun_words(frame(["a"], "word"), frame([], "prefix")).count() == 0


def test_marks_at_the_end():
    assert T.ends_marked("Ende.« ") and T.ends_marked("Ende!\u00a0)\n\"") and not T.ends_marked("Ende") and not T.ends_marked("") and not T.ends_marked(" \" ")
    assert T.without_closers("a.</p> </div>\n") == "a." and T.without_closers("a <p>") == "a <p>" and T.without_closers("x > y>") == "x > y>"


def test_bands_find_near_copies():
    rng = random.Random(2)
    hit = 0
    for _ in range(60):
        a = [f"w{rng.randrange(5000)}" for _ in range(400)]
        b = a[:365]
        x, y = T.shingle_hashes(a), T.shingle_hashes(b)
        assert len(np.intersect1d(x, y)) / len(np.union1d(x, y)) > 0.8
        keys = T.band_matrix(np.concatenate([x, y]), np.repeat([0, 1], [len(x), len(y)]), 2)
        hit += bool((keys[0] == keys[1]).any())
    assert hit == 60
    x, y = (T.shingle_hashes([f"{p}{i}" for i in range(300)]) for p in "ab")
    keys = T.band_matrix(np.concatenate([x, y]), np.repeat([0, 1], [len(x), len(y)]), 2)
    assert not (keys[0] == keys[1]).any()


def test_profile_counts_match_plain_python():
    import pyarrow as pa

    rng = random.Random(5)
    texts = [text(rng, 3) for _ in range(30)] + ["kurz", "zwei worte", "", " \n "]
    batch = pa.RecordBatch.from_pydict({"item_id": list(range(len(texts))), "grp": ["a"] * len(texts), "text": texts, "known": [[] for _ in texts]})
    rows = [r for b in T._profile(iter([batch])) for r in b.to_pylist()]
    words = {r["word"]: r for r in rows if r["word"]}
    uses, ends = {}, {}
    for t in texts:
        lines = [x for x in t.split("\n") if x.strip()]
        flat = [(w, k == len(lines) - 1) for k, x in enumerate(lines) for w in x.split()]
        for j, (w, final) in enumerate(flat):
            if j < len(flat) - 1:
                uses[w.strip(T._AROUND)] = uses.get(w.strip(T._AROUND), 0) + 1
                if w.endswith("."):
                    ends[w.strip(T._AROUND)] = ends.get(w.strip(T._AROUND), 0) + 1
    assert {w: r["n_all"] for w, r in words.items() if r["n_all"]} == uses
    assert all(words[w]["n_end"] >= n for w, n in ends.items())
    docs = {r["item_id"]: r for r in rows if r["item_id"] is not None}
    assert docs[30]["n_words"] == 1 and docs[31]["n_words"] == 2 and len(docs[31]["keys"]) == T.BANDS
    # a short text's keys don't depend on what stands beside it
    alone = pa.RecordBatch.from_pydict({"item_id": [1], "grp": ["a"], "text": ["zwei worte"], "known": [[]]})
    assert next(r for b in T._profile(iter([alone])) for r in b.to_pylist() if r["item_id"] == 1)["keys"] == docs[31]["keys"]


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "wort " * 200_000, None), (4, "Ein Satz.", None), (4, "Ein Satz.", None), (5, "...", "a"), (6, "…", "a"), (7, "\n\n", "a")]
    df = spark.createDataFrame([(*r, "g", 1, True) for r in rows], DDL + ", grp string, item_id int, truncated boolean")
    got = {r[0] for r in T.find_truncated(df).collect()}
    assert got <= {3}
    assert T.find_truncated(df.limit(0)).count() == 0
    by = {r["source"]: r for r in T.truncation_by_source(df).collect()}
    assert by["a"]["n_docs"] == 4 and by["a"]["n_truncated"] == 0


def test_given_tables(spark, sf):
    docs = read_table(spark, sf, "documents")
    found = T.find_truncated(docs)
    assert 0 < found.count() < docs.count() / 4


def test_copies_that_end_alike_make_no_pairs(spark, monkeypatch):
    rng = random.Random(8)
    parts = [sentence(rng) for _ in range(30)]
    family = [" ".join([*parts[:k], f"Ausgabe{k}", *parts[k + 1 :]])[:-1] for k in range(25)]  # all end without a mark, none is cut
    rows = [(i, t, "a") for i, t in enumerate(family)] + [(100 + i, text(rng), "b") for i in range(30)]
    seen, align = [], T._align
    monkeypatch.setattr(T, "_align", lambda batches: align(batches))
    df = spark.createDataFrame(rows, DDL)
    cut = T.cut
    monkeypatch.setattr(T, "cut", lambda d, name="table": seen.append(out.count()) or out if (out := cut(d, name)) is not None and name == "pairs" else out)
    got = {r["item_id"]: r for r in T.judge(df).collect()}
    assert sum(seen) == 0 and not any(got[i]["near_copy"] for i in range(25))
    # one that goes on ends all of them early
    seen.clear()
    whole = " ".join(parts[:29]) + " " + parts[29][:-1] + " " + sentence(rng)
    got = {r["item_id"]: r for r in T.judge(spark.createDataFrame([*rows, (50, whole, "c")], DDL)).collect()}
    assert all(got[i]["aligned_early"] for i in range(25) if i != 29) and not got[50]["truncated"] and sum(seen) <= 30


def test_every_text_that_goes_on_is_met(spark):
    """Early ends found on a given table, against all pairs by an index of all shingles."""
    from quire.llm.sitelines import document_items, mine_templates, remove_repeated

    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    items = document_items(docs)
    own = {r["item_id"]: r["own_text"].rstrip() for r in remove_repeated(items, mine_templates(items)).collect()}
    judged = {r["item_id"]: r for r in T.judge(docs).collect()}
    rng = random.Random(6)
    # the table's own copies, and some texts given again without their end
    more, cut = [], {}
    for k, (i, t) in enumerate(sorted(own.items())):
        words = t.split(" ")
        if judged.get(i) and judged[i]["kind"] == "whole" and len(words) > 90 and rng.random() < 0.15:
            cut[10**7 + k] = " ".join(words[: rng.randint(60, len(words) - 3)])
            more.append((10**7 + k, cut[10**7 + k], "neu"))
    both = docs.select("doc_id", "text", "source").unionByName(spark.createDataFrame(more, DDL))
    judged = {r["item_id"]: r for r in T.judge(both).collect()}
    texts = {**own, **cut}
    shingles = {i: set(T.shingle_hashes(T.words_of(t)).tolist()) for i, t in texts.items()}
    holders = {}
    for i, s in shingles.items():
        for h in s:
            holders.setdefault(h, []).append(i)
    want = set()
    for i, r in judged.items():
        if r["kind"] != "whole":
            common = {}
            for h in shingles[i]:
                for j in holders[h]:
                    common[j] = common.get(j, 0) + 1
            if any(n >= T.SIMILARITY * len(shingles[i]) and T.aligned_early(texts[i], texts[j]) for j, n in common.items() if j != i):
                want.add(i)
    got = {i for i in want if judged[i]["aligned_early"]}
    assert len(want) > 30 and len(got) >= 0.97 * len(want), (len(want), len(got))
