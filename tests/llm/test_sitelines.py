import re
from collections import defaultdict

from quire.llm.sitelines import Known, TokenTree, description_items, document_items, find_repeated_lines, mask_line, mine_templates, path_hash, path_of, remove_repeated, template_hash
from quire.plans.runtime import read_table

DDL = "doc_id long, text string, source string"
LINE = "Diese Leseprobe stammt vom Verlag {}"


def brute(items):
    """(origin, item, line_no) by nested loops over plain Python rows."""
    by = defaultdict(set)
    groups = defaultdict(int)
    rows = []
    for serial, (origin, grp, item, text) in enumerate(items):
        groups[origin, grp] += 1
        for k, line in enumerate(text.split("\n"), 1):
            m = re.sub("[0-9]+", "0", re.sub(r"\s+", " ", line).strip().lower())
            if sum(c.isalpha() for c in m) >= 20:
                by[origin, grp, m].add(serial)
                rows.append((origin, grp, item, k, m))
    return {(o, i, k) for o, g, i, k, m in rows if len(by[o, g, m]) >= 5 and len(by[o, g, m]) * 100 >= 3 * groups[o, g]}


def test_against_brute_force(spark, sf):
    docs, books = read_table(spark, sf, "documents"), read_table(spark, sf, "book_json")
    items = [tuple(r) for df in (document_items(docs), description_items(books)) for r in df.collect()]
    got = {tuple(r) for r in find_repeated_lines(docs, books).collect()}
    assert got == brute(items) and got


def test_masking():
    assert mask_line(" A\u00a0 B\t12 34 ") == "a b 0 0"


def test_paths_and_counts():
    assert path_of("Seite 12 von Anna".split()) == path_of("seite 7 zu ende".split()) == "4 seite <*>"
    assert path_of("Seite zwei von".split()) == "3 seite zwei" and path_of(["x"]) == "1 x"
    tree = TokenTree()
    for item in (1, 2, 2):
        tree.add(("g", "4 seite <*>"), item)
    assert list(tree.drain()) == [("g", "4 seite <*>", 2)] and list(tree.drain()) == []


def test_path_hash_is_sparks(spark):
    paths = ["4 seite <*>", "1 ä", "9 grüße […]"]
    rows = spark.createDataFrame([(x,) for x in paths], "p string").selectExpr("xxhash64(p)").collect()
    assert [r[0] for r in rows] == list(map(path_hash, paths))


def test_only_kept_paths_are_looked_into():
    line = LINE.format(3)
    full, path = {path_hash(path_of(line.split())), template_hash(mask_line(line))}, {path_hash(path_of(line.split()))}
    assert Known(full).holds(line) and not Known(path).holds(line) and not Known(full - path).holds(line)
    assert Known(path).masked(line) == mask_line(line) and Known(path).masked("Diese Leseprobe gibt es hier") is None and Known(None).masked(line) is None


def test_slots_cover_what_only_together_is_frequent(spark):
    # one path, covering all items, but no line of it often enough: nothing is removed
    df = spark.createDataFrame([(i, f"Diese Leseprobe stammt von {name}a{name}", "s") for i, name in enumerate("abcdefghijklmnop")], DDL)
    assert mine_templates(document_items(df)).count() == 0
    more = spark.createDataFrame([(i, t, "s") for i, t in enumerate(["Diese Leseprobe stammt von anna", "Diese Leseprobe stammt von bert"] * 5 + ["Diese Leseprobe stammt von carl"])], DDL)
    got = mine_templates(document_items(more)).collect()
    assert {(r["template"], r["n_items"], r["path"], r["n_group"]) for r in got} == {(f"diese leseprobe stammt von {n}", 5, "5 diese leseprobe", 11) for n in ("anna", "bert")}


def test_thresholds_and_spellings(spark):
    texts = [LINE.format(i) + "\nEigen" for i in range(4)] + ["  " + LINE.format(9).upper() + "\u00a0\nEigen"] + ["nur dies"] * 100
    df = spark.createDataFrame([(i, t, " S ") for i, t in enumerate(texts)], DDL)
    got = remove_repeated(document_items(df), mine_templates(document_items(df))).where("size(line_nos) > 0").collect()
    assert {r["item_id"] for r in got} == {0, 1, 2, 3, 4} and {r["own_text"] for r in got} == {"Eigen"}
    more = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts + ["x"] * 100)], DDL)
    assert mine_templates(document_items(more)).count() == 0  # 5 of 205 items are under 3 %


def test_line_twice_in_an_item_counts_once(spark):
    df = spark.createDataFrame([(i, "\n".join([LINE.format(1)] * 2), "s") for i in range(4)], DDL)
    assert mine_templates(document_items(df)).count() == 0


def test_edges(spark):
    rows = [(i, LINE.format(i), None) for i in range(6)] + [(7, None, None), (8, "", None), (9, "wort " * 300_000, None)]
    df = spark.createDataFrame([(*r, "g", 1, "k") for r in rows], DDL + ", grp string, item_id int, known string")
    books = spark.createDataFrame([(1, "p", None), (2, "p", "{"), (3, None, "[]"), (4, "p", '{"epub_metadata": {"description": ["a", 3, null]}}')], "record_id long, portal string, body string")
    got = find_repeated_lines(df, books).collect()
    assert {(r["item_id"], r["line_no"]) for r in got} == {(i, 1) for i in range(6)}
    assert sorted(r["item_id"] for r in description_items(books).collect()) == [3, 4]
    none = spark.createDataFrame([], DDL)
    assert find_repeated_lines(none, books.limit(0)).count() == 0
