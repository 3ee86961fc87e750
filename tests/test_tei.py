import json
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from quire.operators import tei, tei_run


def conv(text, kind=None):
    out = tei.Converter().fragment(text, kind)
    ET.fromstring(f"<r>{out}</r>")  # well-formed
    return out


def test_blocks_and_inline():
    assert conv('<p rend="standard-leerzeile">a</p>') == "<lb/><p>a</p>"
    assert conv("<p>a<i>b</i>c<strong>d</strong><br/>e</p>") == '<p>a<hi rend="italic">b</hi>c<hi rend="bold">d</hi><lb/>e</p>'
    assert conv('<hi rend="italic">oben</hi>') == '<p><hi rend="italic">oben</hi></p>'
    assert conv("lose<p>a</p>Ende") == "<p>lose</p><p>a</p><p>Ende</p>"
    assert conv('<svg><image xlink:href="a.jpg"/></svg>') == '<figure><graphic url="a.jpg"/></figure>'
    assert conv("<p>a<blink>b</blink></p>") == '<p>a<uncertain reason="blink">b</uncertain></p>'
    assert conv("a & b < c") == "<p>a &amp; b &lt; c</p>" and conv("") == "" and conv("<p> </p>") == ""
    table = conv("<table><thead><tr><th>A</th></tr></thead><tbody><tr><td>b</td></tr></tbody></table>")
    assert table == '<table><row role="header"><cell>A</cell></row><row><cell>b</cell></row></table>'


def test_divs():
    assert conv('<div class="x y"><h2>T</h2><p>a</p>lose</div>') == '<div type="x"><head>T</head><p>a</p><p>lose</p></div>'
    assert conv("<div><p>a</p></div>") == '<div type="section"><head>Section</head><p>a</p></div>'
    assert tei.convert_divs('<div class="k"><p class="title">T</p><p>a</p><div> </div><div><p>b</p></div></div>') == '<div type="k"><head>T</head><p>a</p></div><div type="unknown"><p>b</p></div>'
    got = tei.convert_divs('<div><p>a <hi rend="class1752">b</hi> c<u x="1">d</u></p><hi rend="class-0"> e </hi><hi rend="z">f</hi><graphic url="g"/><lb/><q k="v"> h<i>i</i></q>lose</div>')
    assert got == '<div type="unknown"><p>a <hi rend="italic">b</hi> c<u x="1">d</u></p><p>e</p><hi rend="z">f</hi><graphic url="g"/><lb/><q k="v">hi</q></div>'
    copied = tei.Converter(copy_unknown=True).fragment('<p>a<blink tag="x">b</blink></p>')
    assert copied == '<p>a<blink tag="x">b</blink></p>'


def test_chapter_head_and_toc():
    long = "Satz " * 60
    assert conv(f"<p> </p><p>{long}</p><p>a</p>", "chapter") == f"<head>{long.strip()}</head><p>a</p>"
    assert conv(" davor<p> 1 </p><p>a</p>", "chapter") == "<head>1</head><p>davor</p><p>a</p>"
    assert conv("<p>Eins</p><p><i>Zwei</i></p>", "toc") == "<list><item>Eins</item><item>Zwei</item></list>"


def test_books():
    book = {"title": "T&", "epub_metadata": {"creator": ["A", "B"], "date": "2020", "identifier": ["x", "urn:uuid:1"], "language": "de"}, "content": [{"inferred-type": "cover", "text": "<p>c</p>"}, {"text": "<p>ohne</p>"}, {"type": "Section", "content": [{"inferred-type": "chapter", "text": "<p>1</p><p>a</p>"}]}, {"inferred-type": "unkown", "href": "x/part0000.xhtml", "text": "u"}]}
    root = ET.fromstring(tei.book_to_tei(json.dumps(book)))
    ns = {"t": "http://www.tei-c.org/ns/1.0"}
    assert [d.get("type") for d in root.findall("t:text/t:front/t:div", ns)] == ["cover", "cover"]
    assert root.find("t:text/t:body/t:div/t:head", ns).text == "1" and root.find(".//t:author", ns).text == "A" and root.find(".//t:idno", ns).text == "urn:uuid:1"
    nested = {"content": [{"inferred-type": "chapter", "text": "1", "content": [{"inferred-type": "chapter", "text": "2"}]}, {"inferred-type": "chapter", "text": "3"}, {"inferred-type": "unkown", "title": "Vorwort", "text": "v"}]}
    root = ET.fromstring(tei.book_to_tei(json.dumps(nested), frozenset(["Vorwort"])))
    assert [d.find("t:p", ns).text for d in root.findall("t:text/t:body/t:div", ns)] == ["1", "2", "3"] and root.find("t:text/t:front/t:div", ns).get("type") == "foreword"
    assert tei.route("unkown", "x", "Vorwort") == ("front", "unkown")
    assert tei.book_to_tei("{") is None and tei.book_to_tei("[]") is None and "<body></body>" in tei.book_to_html("{}")
    assert tei.book_to_html(json.dumps(book)).count("<div") == tei.book_to_html(json.dumps(book)).count("</div>") == 5


def test_columns(spark):
    df = spark.createDataFrame([("```xml\n<div type=\"toc\">a</div>\n```", "implicit_chapter_stars"), (" x\n\ny ", "explicit_chapter"), ("z ```", "implicit_chapter_jpg")], "a string, s string")
    rows = df.select(tei.strip_fence(F.col("a")).alias("a"), tei.second_fence(F.col("a")).alias("b"), tei.div_type(F.col("a")).alias("t"), tei.wrap(F.col("a"), F.col("s"), "    ").alias("w")).collect()
    assert [tuple(r)[:3] for r in rows] == [('<div type="toc">a</div>', '<div type="toc">a</div>', "toc"), ("x\n\ny", "x\n\ny", "unknown"), ("z ```", "", "unknown")]
    assert rows[1]["w"] == '<div type="chapter">\n     x\n\n    y \n</div>' and rows[0]["w"].startswith('<div type="chapter" rend="separator">\n    ```xml') and rows[2]["w"].startswith('<div type="chapter" rend="image-separator">')
    assert df.select(tei.wrap(F.lit("x"), F.lit("explicit_chapter"))).first()[0] == '<div type="chapter">\nx\n</div>'
    for wrong in ("novel_no_separator", "non-chapter"):
        with pytest.raises(Exception, match="no wrapping"):
            df.select(tei.wrap(F.lit("x"), F.lit(wrong))).collect()
    got = tei.convert(spark.createDataFrame([("1", None, "x"), ("2", "<p>a</p>", None)], "id string, text string, out string"), "id", "text").collect()
    assert [tuple(r) for r in got] == [("1", None), ("2", "<p>a</p>")]


UNITS = "id string, html string, strategy string"


def test_run(spark):
    rows = [("a", "<p>1</p>", "explicit_chapter"), ("b", "<p>2</p>", "implicit_chapter_stars"), ("c", "<p>3<x>u</x></p>", "non-chapter"), ("d", "<p>4</p>", "novel_no_separator"), ("e", "<p>5</p>", "explicit_chapter"), ("f", None, "non-chapter")]
    units, done = spark.createDataFrame(rows, UNITS), spark.createDataFrame([("e",), ("e",)], "id string")
    out, log = tei_run.run(units, F.lit("now"), done=done)
    assert {tuple(r) for r in out.collect()} == {("a", '<div type="chapter">\n<p>1</p>\n</div>'), ("b", '<div type="chapter" rend="separator">\n<p>2</p>\n</div>'), ("c", '<div type="unknown"><p>3<uncertain reason="x">u</uncertain></p></div>')}
    got = {r["chunk_id"]: tuple(r) for r in log.collect()}
    assert log.columns == list(tei_run.LOG) and set(got) == {"a", "b", "c", "d"}
    assert got["a"][2:7] == ("Success", "explicit_chapter", "Script-Wrapped", "no", "no") and got["c"][4:7] == ("LLM-Wrapped", "no", "YES (<div type='unknown'>)") and got["d"][2:5] == ("Skipped", "novel_no_separator", "None")

    def sometimes(prompts):
        if any("3" in p for p in prompts):
            raise OSError("weg")
        return ["<p><uncertain>x</uncertain></p>"] * len(prompts)

    out, log = tei_run.run(units, F.lit("now"), sometimes, batch=1, tries=2, base=0.0)
    got = {r["chunk_id"]: r for r in log.collect()}
    assert got["c"]["status"] == "Error" and "weg" in got["c"]["error_message"] and got["a"]["uncertain_found"] == "YES (<uncertain>)" and {r["id"] for r in out.collect()} == {"a", "b", "e"}
    for chapters, others, want in ((True, False, {"a", "b", "e"}), (False, True, {"c", "f"}), (False, False, set())):
        assert {r["id"] for r in tei_run.select_units(units, chapters, others).collect()} == want
    assert [x.count() for x in tei_run.run(units.limit(0), F.lit("now"))] == [0, 0]


def test_prefixes_and_coverage(spark):
    df = spark.createDataFrame([('<ns0:TEI xmlns:ns0="http://x"><ns0:p a="1">t</ns0:p></ns0:TEI>',), ("<p>a<blink>b</blink><i>c</i></p>",), (None,)], "t string")
    assert [r[0] for r in df.select(tei.front_first_strip_prefix(F.col("t"))).collect()] == ['<TEI><p a="1">t</p></TEI>', "<p>a<blink>b</blink><i>c</i></p>", None]
    got = {r["tag"]: r["handled"] for r in tei.coverage(df.where("t NOT LIKE '%ns0%'").withColumn("id", F.lit("1")), "id", "t").collect()}
    assert got == {"p": True, "i": True, "blink": False}
    assert tei.coverage(df.limit(0).withColumn("id", F.lit("1")), "id", "t").count() == 0
