from collections import Counter
from html.parser import HTMLParser
from xml.etree import ElementTree

from hypothesis import given, settings
from hypothesis import strategies as st

from quire.operators import shred, structure
from quire.plans.runtime import read_table

DDL = "doc string, frag string, text string"


def els(text):
    return [(e[1], e[2], e[4]) for e in shred.elements_of(text)]


def test_tree_rules():
    assert els("<DIV><p>a<p>b</DIV>c<x/>") == [("div", None, 1), ("p", 0, 2), ("p", 1, 3), ("x", None, 1)]
    assert els("<p>a<br>b<br/>c</p></i><b>") == [("p", None, 1), ("br", 0, 2), ("br", 0, 2), ("b", None, 1)]
    assert els("<!-- <p> --><script>if (a<b) '</p>'</script><p>") == [("script", None, 1), ("p", None, 1)]
    assert els("a < b und <3 und <10 Grad") == []


def test_attributes_and_siblings():
    e = shred.elements_of('<p class="a  b" STYLE="x:1" k=v q>T&amp;U<i/></p><head>H</head>')
    assert e[0][5] == {"class": "a  b", "style": "x:1", "k": "v", "q": ""} and e[0][6] == ["a", "b"] and e[0][8] == "T&U" and e[0][10] == "head" and e[2][9] == "p"


def test_nesting_counts_direct_chains(spark):
    rows = [("d", "1", "<div><div><p><div></div></p></div></div><list><list/></list>"), ("d", "2", "<div/>")]
    got = {r["tag"]: (r["max_depth"], r["mean_depth"], r["n_chains"]) for r in structure.nesting_depth(shred.elements(spark.createDataFrame(rows, DDL), "doc", "frag", "text")).collect()}
    # the div in a p is in a div already: it begins no chain, and continues none
    assert got == {"div": (2, 1.5, 2), "list": (2, 2.0, 1)}
    rows = [("d", "1", "<div><p><div>x</div></p><div>y</div></div>")]
    got = structure.nesting_depth(shred.elements(spark.createDataFrame(rows, DDL), "doc", "frag", "text")).collect()
    assert [(r["max_depth"], r["mean_depth"], r["n_chains"]) for r in got] == [(2, 2.0, 1)]


def brute_depth(e):
    """The chain of direct children of the same tag, by recursion over another parser's tree."""
    return 1 + max((brute_depth(c) for c in e if c.tag == e.tag), default=0)


def brute_outermost(e, above=()):
    if e.tag not in above:
        yield e
    for c in e:
        yield from brute_outermost(c, (*above, e.tag))


@settings(max_examples=150, deadline=None)
@given(st.recursive(st.sampled_from(["<div/>", "<p/>", "<list/>", "t"]), lambda inner: st.tuples(st.sampled_from(["div", "p", "list"]), st.lists(inner, max_size=4)).map(lambda x: f"<{x[0]}>{''.join(x[1])}</{x[0]}>"), max_leaves=20))
def test_nesting_and_parents_by_another_parser(text):
    root = ElementTree.fromstring(f"<root>{text}</root>")
    found = shred.elements_of(text)
    want = sorted((e.tag, brute_depth(e)) for c in root for e in brute_outermost(c))
    assert sorted((e[1], e[7]) for e in found if e[7] is not None) == want
    parents = Counter((c.tag, e.tag if e is not root else None) for e in root.iter() for c in e)
    assert Counter((e[1], e[3]) for e in found) == parents


def test_parents_at_the_top(spark):
    rows = [("d", "1", "<p>a</p><div><p/><x><p/></x></div>")]
    e = shred.elements(spark.createDataFrame(rows, DDL), "doc", "frag", "text")
    assert {(r["child"], r["parent"], r["n"]) for r in structure.parent_child(e).collect()} == {("p", "[document]", 1), ("div", "[document]", 1), ("p", "div", 1), ("p", "x", 1)}
    assert {r["child"] for r in structure.parent_child(e, structure.STRUCTURAL_BY_PUBLISHER, "doc_id").collect()} == {"p", "div"}


def test_heading_context(spark):
    rows = [("d", "1", "<p class=\"a\">x</p><h1>A &amp; B</h1>text<div><head>C</head></div>"), ("d", "2", None), ("d", "3", "kein"), ("d", "4", "<h2/>")]
    got = {(r["frag_id"], r["pos"]): tuple(r)[3:] for r in structure.heading_context(spark.createDataFrame(rows, DDL), "doc", "frag", "text").collect()}
    assert got == {("1", 0): ("h1", "<h1>A &amp; B</h1>", '<p class="a">x</p>', "text"), ("1", 1): ("head", "<head>C</head>", None, None), ("4", 0): ("h2", "<h2/>", None, None)}


def test_list_values_and_inventory(spark):
    rows = [("d", "1", '<p class="a  b" style="color: x; y:1; plain" title="a b"/><a rel="n m" class="a"/>')]
    df = spark.createDataFrame(rows, DDL)
    tags = shred.open_tags(df, "doc", "frag", "text")
    attrs = shred.attributes(tags)
    values = {(r["tag"], r["name"], r["value"]) for r in structure.split_values(attrs).collect()}
    assert values == {("p", "class", "a"), ("p", "class", "b"), ("p", "style", "color: x; y:1; plain"), ("p", "title", "a b"), ("a", "rel", "n"), ("a", "rel", "m"), ("a", "class", "a")}
    kinds = spark.createDataFrame([("d", "1", "inferred-type", "toc")], "doc_id string, frag_id string, name string, value string")
    got = {(r["tag"], r["kind"], r["value"]) for r in structure.tag_inventory(tags, attrs, kinds).where("kind IN ('css', 'type')").collect()}
    assert got == {("p", "css", "color"), ("p", "css", "y"), ("p", "type", "toc"), ("a", "type", "toc")}
    items = Counter(r["item"] for r in structure.tag_and_class(tags, attrs).collect())
    assert items == {"p": 1, "a": 1, "p.a": 1, "p.b": 1, "a.a": 1}
    ranked = structure.most_common(spark.createDataFrame([("x", 1), ("b", 2), ("a", 2)], "k string, n long"), "k").collect()
    assert [r["k"] for r in ranked] == ["a", "b", "x"]


def test_visible_text():
    assert shred.html_text("<p> a </p>b<i>c&nbsp;</i><!-- x -->\n") == "a b c" and shred.html_text(None) is None and shred.html_text("") == ""


def test_three_ways_agree(spark, sf):
    class Count(HTMLParser):
        def __init__(self):
            super().__init__()
            self.c = Counter()

        def handle_starttag(self, tag, attrs):
            self.c[tag] += 1

    chunks = read_table(spark, sf, "chunks")
    plain = Count()
    for r in chunks.where("text IS NOT NULL").select("text").collect():
        plain.feed(r["text"])
        plain.reset()
    native = {r["tag"]: r["n"] for r in structure.frequency(shred.open_tags(chunks, "source_file", "id", "text"), "tag").collect()}
    parsed = {r["tag"]: r["n"] for r in structure.frequency(shred.elements(chunks, "source_file", "id", "text"), "tag").collect()}
    assert native == parsed == dict(plain.c)


def test_book_ngrams_cross_borders(spark):
    ddl = "id string, source_file string, text string, node_ord long, part_no long"
    rows = [("a", "f", "<p><i>", 0, 0), ("b", "f", "<b>", 1, 0), ("b", "f", "<b>", 1, 0), ("n", "f", None, 2, 0), ("c", "f", "kein", 3, 0), ("d", "f", "<u>", 4, 0), ("e", "g", "<p>", 0, 0)]
    df = spark.createDataFrame(rows, ddl)
    assert {r["ngram"] for r in structure.book_ngrams(df, 2).collect()} == {"p -> i", "i -> b", "b -> u"}
    assert {r["ngram"] for r in structure.book_ngrams(df, 3).collect()} == {"p -> i -> b", "i -> b -> u"}
    assert structure.book_ngrams(df.limit(0), 2).count() == 0
