import re

import pytest

from quire.llm.markup import constructs, deduce_templates, extract_plain_text, find_markup, render, scan

DDL = "doc_id long, text string, source string"


def strong(text):
    return [t for t, _, s, _, _ in scan(text) if s]


@pytest.mark.parametrize("text", [
    "<p>a</p>", "a <br/> b", "&lt;p&gt;a", "a &nbsp; b", "a </span> b", "<!-- pb --> a", "# Head\n\na", "Head\n====\na", "a **b** c", "a ~~b~~", "a `b` c", "[a](b.xhtml)", "a ](k.xhtml) b", "a[^1] b",
    "== H ==\na", "a '''b''' c", "[[A|b]]", "{{Zitat|b}}", "{|\n|-\n| a || b\n|}", "\\section{A}", "a \\textbf{b}", "a \\\\[2ex] b", "x $x^{2}$ y", "d{\\\"u}ne", "a \\par b", "```\nx\n```", "|a|b|\n|---|---|\n|c|d|", "<style>.a{}</style>x", "a <p",
])
def test_constructs_are_found(text):
    assert strong(text)


@pytest.mark.parametrize("text", [
    "Er schrieb a < b und b > c an die Tafel.", "Hab dich lieb <3 stand dort.", "auf <10 Grad", "R&B lief", "Blatt & Bogen", "Heft #17 fehlt", "Das Wort [sic] stand", "»[...] und nie wieder!«", "Er lachte ^^ und ging.", "Die Menge {1, 2, 3} genügte.",
    "Der Preis lag bei 5 $ oder 4 €.", "Es galt 2 * 3 = 6.", "Wert ~ 40 %", "heft_12_neu.txt", "C:\\Romane\\Heft lag", "a\n* * *\nb", "a\n***\nb", "• a\n• b", "Teilen | Merken | Drucken", "", "plain",
])
def test_prose_signs_are_not(text):
    assert not strong(text)
    assert render(text, frozenset()) == text


def roles(text):
    return [(c[0], c[1]) for c in constructs(text)]


def test_roles():
    assert roles("<p>a <b>x</p></b>") == [("<p>", "pair"), ("<b>", "remnant"), ("</p>", "pair"), ("</b>", "remnant")]
    assert [c[6] for c in constructs("<p>a <b>x</p></b>")] == [True, False, True, False] and not any(c[6] for c in constructs("<ul><li>x<li>y</ul>"))
    assert roles("\\textbf{a{b} c} \\emph{b") == [("\\textbf{", "pair"), ("\\emph{", "remnant")]
    assert roles("'''a''' ''b") == [("'''", "pair"), ("'''", "pair"), ("''", "remnant")]
    assert roles("<br> <pb n='1'/> <p cla") == [("<br>", "pair"), ("<pb>", "pair"), ("<p>", "remnant")]
    assert roles("- a **b** **c &amp;") == [("-", "single"), ("**", "pair"), ("**", "remnant"), ("&amp;", "pair")]
    assert [c[5] for c in constructs("<div><p>a</p>- b</div>")] == [None, "<div>", "<div>", None]


def test_what_no_valid_class_holds_is_no_markup(spark):
    # </x> never has its other half anywhere; a remnant of <p> is known from another site; <u> and <v> cross
    rows = [(1, "ein </x> wort", "a"), (2, "ein </p> wort", "a"), (3, "<p>ganz</p>", "b")] + [(10 + i, "<u>a <v>b</u> c</v>", "c") for i in range(5)]
    df = spark.createDataFrame(rows, DDL)
    assert {r[0] for r in find_markup(df).collect()} == {2, 3}
    by = {(r["token"], r["role"]): r for r in deduce_templates(df).where("site = 'c'").collect()}
    assert not by["<u>", "pair"]["valid"] and not by["<u>", "pair"]["is_markup"] and not by["<v>", "remnant"]["is_markup"]
    plain = {r["doc_id"]: r["plain_text"] for r in extract_plain_text(df).collect()}
    assert plain[1] == "ein </x> wort" and plain[2].split() == ["ein", "wort"]


def test_slots_are_what_the_template_leaves():
    text = "<p>a</p> & <x>b</x> [c](d)"
    assert render(text, frozenset({("<p>", "pair"), ("</p>", "pair")})) == "a\n\n& <x>b</x> [c](d)"
    assert "<x>" not in render(text) and "(d)" not in render(text)


def test_structure_is_kept():
    out = render("<h1>Titel</h1><p>Ein <i>Wort</i> &amp; mehr.</p><ul><li>eins</li><li>zwei</li></ul><pre><code>if a &lt; 1:\n    b</code></pre><p>Es gilt <math>x^2</math>.</p>")
    assert "# Titel" in out and "Ein Wort & mehr." in out and "- eins\n- zwei" in out and "```\nif a < 1:\n    b\n```" in out and "$x^2$" in out
    out = render("\\section{Titel}\n\n\\glqq Ein\\grqq{} Wort.\n\\begin{itemize}\n\\item eins\n\\end{itemize}\n\\begin{tabular}{ll}\na & 1 \\\\\nb & 2 \\\\\n\\end{tabular}")
    assert out.startswith("# Titel") and "„Ein“ Wort." in out and "- eins" in out and "a | 1\nb | 2" in out
    out = render("== Titel ==\n'''Ein''' [[A|Wort]] {{Zitat|hier}}<ref>S. 1</ref>.\n{|\n|-\n| a || 1\n|}\n[[Kategorie:X]]")
    assert out.startswith("# Titel") and "Ein Wort hier." in out and "a | 1" in out and "Kategorie" not in out
    assert render('a\n<source lang="text">\n<teil n="1">\n  <kopf>x</kopf>\n</teil>\n</source>\nb') == 'a\n\n```\n<teil n="1">\n  <kopf>x</kopf>\n</teil>\n```\n\nb'
    out = render("Titel\n=====\n\n**Ein** _Wort_[^1].\n\n| a | 1 |\n|---|---|\n| b | 2 |\n\n```py\nx = 1\n```")
    assert out.startswith("# Titel") and "Ein Wort." in out and "a | 1\nb | 2" in out and "```\nx = 1\n```" in out


def test_scan_spans_match_and_do_not_overlap():
    text = "<p>a **b** [[c]] \\textit{d} &amp; e</p>\n- f\n# g\n" * 3
    end = 0
    for _, _, _, a, z in scan(text):
        assert end <= a < z <= len(text)
        end = z


def test_templates_pair_and_nest(spark):
    rows = [(i, f"<html><body><p>Text {i} <i>x</i></p></body></html>" if i % 2 else "<html><body><p>kein</p></body></html>", "A ") for i in range(8)]
    got = {r["token"]: r for r in deduce_templates(spark.createDataFrame(rows, DDL)).collect()}
    assert got["<html>"]["class_id"] == got["</html>"]["class_id"] == got["<p>"]["class_id"] != got["<i>"]["class_id"]
    assert got["<i>"]["valid"] and got["<i>"]["parent"] == "<p>" and got["<body>"]["parent"] == "<html>"
    assert got["<p>"]["support"] == 8 and got["<i>"]["support"] == 4


def test_weak_tokens_follow_the_template(spark):
    with_md = [(i, "# Liste\n\n* eins\n* zwei", "md") for i in range(6)]
    alone = [(10 + i, "* eins\n* zwei", "md") for i in range(2)]
    prose = [(20 + i, "* eins\n* zwei", "prosa") for i in range(6)]
    got = {r[0] for r in find_markup(spark.createDataFrame(with_md + alone + prose, DDL)).collect()}
    assert got == {0, 1, 2, 3, 4, 5, 10, 11}


def test_edges(spark):
    long = "<p>" + "wort " * 200_000 + "</p>"
    rows = [(1, None, "a"), (2, "", "a"), (3, long, None), (3, long, None), (4, "prosa", "a")]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], DDL + ", site string, n int, token string")
    got = sorted((r["doc_id"], r["n_constructs"]) for r in extract_plain_text(df).collect())
    assert got == [(3, 2), (3, 2), (4, 0)]
    assert [r[0] for r in find_markup(df).collect()] == [3]
    empty = spark.createDataFrame([], DDL)
    assert find_markup(empty).count() == 0 and deduce_templates(empty).count() == 0


def test_prose_is_untouched(spark):
    text = "Ein Satz.  Zwei Blanks, [sic] und 2 * 3.\n\n* * *\n\tEnde"
    got = extract_plain_text(spark.createDataFrame([(1, text, "a")], DDL)).collect()
    assert got[0]["plain_text"] == text and not re.search("<", got[0]["plain_text"])
