import re

import pytest

from quire.operators import chunking

DDL = "id string, f string, t string, k string"
STAR = "<p>***</p>"


def units(spark, *rows):
    df = spark.createDataFrame([(f"n{i}", "f.json", t, k) for i, (t, k) in enumerate(rows)], DDL)
    return [(r["id"], r["html"], r["strategy"]) for r in chunking.work_units(df, "id", "f", "t", "k").orderBy("id").collect()]


@pytest.mark.parametrize("sep", ["<p>***</p>", '<p rend="s"> * * * </p>', "<p> * ** </p>", "<pre>**</p>", "<p>" + "*" * 5000 + "</p>"])
def test_star_separators(spark, sep):
    assert units(spark, (f"a{sep}b", "novel")) == [("n0_part01", "a", "implicit_chapter_stars"), ("n0_part02", "b", "implicit_chapter_stars")]


def test_blank_parts_go_before_numbering(spark):
    assert [u[:2] for u in units(spark, (f"{STAR}a{STAR}   {STAR}b{STAR}", "novel"))] == [("n0_part01", "a"), ("n0_part02", "b")]
    assert units(spark, (STAR + STAR, "novel")) == []


def test_images(spark):
    jpg = '<p><graphic url="a.jpg"/></p>'
    assert [u[1] for u in units(spark, (f"a{jpg}b<p><p>\n<graphic url=\"b.jpg\" rend=\"i\"/></p></p>c", "novel"))] == ["a", "b", "c"]
    for other in ('<p><graphic url="a.png"/></p>', '<p><graphic url="a.JPG"/></p>'):
        assert units(spark, (f"a{other}b", "novel"))[0][2] == "novel_no_separator"
    both = units(spark, (f"a{jpg}b{STAR}c", "novel"))
    assert [u[1] for u in both] == [f"a{jpg}b", "c"]


def test_strategies(spark):
    got = units(spark, (f"a{STAR}b", "Chapter 3"), (f"a{STAR}b", "toc"), (f"a{STAR}b", None), ("  \n", "novel"), (None, "novel"), ("", "chapter"), ("x", "novel"))
    assert [(i, s) for i, _, s in got] == [("n0", "explicit_chapter"), ("n1", "non-chapter"), ("n2", "non-chapter"), ("n6", "novel_no_separator")]


def test_parts_and_separators_are_the_input(spark):
    text = f"a{STAR}b <p> ** </p>c"
    parts = [u[1] for u in units(spark, (text, "novel"))]
    seps = re.findall(r"<p[^>]*>[\s*]*\*[\s*]*</p>", text)
    assert "".join(x for pair in zip(parts, [*seps, ""]) for x in pair) == text


def test_reports_are_zero_filled(spark):
    df = spark.createDataFrame([("n", "f.json", "x", "toc"), ("m", "g.json", f"a{STAR}b", "novel")], DDL)
    u = chunking.work_units(df, "id", "f", "t", "k")
    agg = {r["strategy"]: r["chunk_count"] for r in chunking.strategy_aggregate(u).collect()}
    assert agg == {"explicit_chapter": 0, "implicit_chapter_stars": 2, "implicit_chapter_jpg": 0, "novel_no_separator": 0, "non-chapter": 1, "total": 3}
    rows = {r["source_file"]: r for r in chunking.strategy_report(u).collect()}
    assert rows["f.json"]["total"] == 1 and rows["f.json"]["implicit_chapter_stars"] == 0
    none = chunking.strategy_aggregate(u.limit(0)).collect()
    assert len(none) == 6 and all(r["chunk_count"] == 0 for r in none)


def test_index_ranges_and_literal_split(spark):
    df = spark.createDataFrame([(f"b_{p}_{k}", "f", i) for i, (p, k) in enumerate([("x", 1), ("x", 2), ("y", 1), ("x", 3)])], "id string, source_file string, o int")
    got = sorted((r["prefix"], r["start_idx"], r["end_idx"]) for r in chunking.index_ranges(df, "source_file", ["o"]).collect())
    assert got == [("b_x", 0, 1), ("b_x", 3, 3), ("b_y", 2, 2)]
    df = spark.createDataFrame([("a", "x*** ***y"), ("b", None)], "id string, t string")
    assert [r["part_no"] for r in chunking.literal_split(df, "id", "t").orderBy("part_no").collect()] == [0, 2]
