import json
import os

import pytest
from pyspark.sql import functions as F

from quire.functions import names
from quire.functions.text import label_key
from quire.operators import classify, textstats
from quire.plans.runtime import cut, cut_bytes, drop_cut, join_checked, numbered_within, shared_dir
from quire.sources import readers, sinks
from quire.streaming.resume import classify_available


def test_model_run_and_sentinels(spark):
    df = spark.createDataFrame([("a", "x" * 2000), ("a", "x" * 2000), ("b", "  "), ("c", None), ("d", "y" * 300), (None, "z")], "id string, text string")
    got = {r["id"]: (r["label"], r["status"]) for r in classify.run_model(df, most=1000).collect()}
    assert got == {"a": ("too_long", "Skipped"), "b": ("no_text", "Skipped"), "c": ("no_text", "Skipped"), "d": ("unknown", "Success")}

    def bad(prompts):
        raise RuntimeError("boom")

    got = {r["id"]: (r["label"], r["status"]) for r in classify.run_model(df, bad, most=1000, tries=2, base=0.0).collect()}
    assert got["d"] == ("batch_error", "Error") and got["b"][0] == "no_text"
    got = {r["id"]: r["label"] for r in classify.run_model(df, lambda p: ["no json"] * len(p)).collect()}
    assert got["a"] == "parsing_error"
    assert {r["id"] for r in classify.pending(df.where("id IS NOT NULL"), spark.createDataFrame([("a",)], "id string")).collect()} == {"b", "c", "d"}


def test_retry():
    waits, calls = [], []

    def flaky(prompts):
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return ["ok"]

    assert classify.with_retry(flaky, sleep=waits.append)(["p"]) == ["ok"] and waits == [1, 2]
    with pytest.raises(ZeroDivisionError):
        classify.with_retry(lambda p: 1 / 0, tries=2, sleep=lambda s: None)(["p"])


def test_calls_pause_between():
    import pyarrow as pa

    waits = []
    batch = pa.RecordBatch.from_pydict({"id": ["a", "b", "c"], "prompt": ["x", "y", "z"]})
    rows = [r for b in classify._caller(lambda p: p, 2, 0.5, waits.append)(iter([batch, batch])) for r in b.to_pylist()]
    assert waits == [0.5] * 3 and [r["answer"] for r in rows] == ["x", "y", "z"] * 2


def test_prompts(spark):
    r = spark.createDataFrame([("t {x}",)], "t string").select(classify.role_split(F.col("t"), "sys", "HTML: ").alias("m"), classify.escape_braces(F.col("t")).alias("e")).first()
    assert [tuple(m) for m in r["m"]] == [("system", "sys"), ("user", "HTML: t {x}")] and r["e"] == "t {{x}}"


def test_incremental_run(spark, tmp_path):
    src, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    df = spark.createDataFrame([("a", "x" * 2000), ("b", None)], "id string, text string")
    df.write.parquet(src)
    classify_available(spark, src, df.schema, out, check)
    assert spark.read.parquet(out).count() == 2
    spark.createDataFrame([("b", "x"), ("c", "y")], "id string, text string").write.mode("append").parquet(src)
    classify_available(spark, src, df.schema, out, check)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_readers(spark, tmp_path):
    (tmp_path / "books" / "sub").mkdir(parents=True)
    (tmp_path / "books" / "a.json").write_text('{"title": "T"}')
    (tmp_path / "books" / "b.json").write_text("{")
    (tmp_path / "books" / "c.txt").write_text("{}")
    (tmp_path / "books" / "sub" / "d.json").write_text("[]")
    flat = readers.read_book_files(spark, str(tmp_path / "books"))
    assert {(r["source_file"], r["valid"]) for r in flat.collect()} == {("a.json", True), ("b.json", False)}
    deep = readers.read_book_files(spark, str(tmp_path / "books"), recursive=True)
    good, bad = readers.split_rejects(deep)
    assert good.count() == 2 and bad.count() == 1
    assert [r["source_file"] for r in readers.slice_sorted(deep, 1, 3).collect()] == ["b.json", "d.json"]
    with pytest.raises(Exception, match="no JSON object"):
        readers.require_object(deep).collect()
    (tmp_path / "t.tsv").write_text("ID\tTitle\tPublisher\tSeries\tDate\n007\tnone\t\t?\tx\n")
    row = readers.read_tsv(spark, str(tmp_path / "t.tsv"), readers.BOOKS_META).first()
    assert tuple(row) == ("007", "none", None, "?", "x")
    for name, body in (("1.json", '[{"id":"a","text":"alt"},{"id":"b","text":"t"}]'), ("2.json", '[{"id":"a","text":"neu"}]'), ("3.json", '{"id":"c","text":"eins"}')):
        os.makedirs(tmp_path / "chunks", exist_ok=True)
        (tmp_path / "chunks" / name).write_text(body)
    assert {tuple(r) for r in readers.read_chunk_files(spark, str(tmp_path / "chunks")).collect()} == {("a", "neu"), ("b", "t"), ("c", "eins")}
    maps = spark.createDataFrame([("p1", '[{"a":"toc"},{"a":"imprint","b":"chapter"}]'), ("p2", '[{"b":"toc"}]'), ("p3", "{")], "path string, body string")
    assert {tuple(r) for r in readers.merge_label_maps(maps).collect()} == {("a", "imprint"), ("b", "toc")}
    (tmp_path / "e").mkdir()
    for n in ("b c.EPUB", "a.epub", "x.txt"):
        (tmp_path / "e" / n).write_text("x")
    plan = readers.epub_plan(readers.list_epubs(spark, str(tmp_path / "e")).select(F.replace("name", F.lit("%20"), F.lit(" ")).alias("name")))
    assert sorted(r["dst"] for r in plan.collect()) == ["000001_a.epub", "000002_b_c.EPUB"]
    assert {r["id"] for r in readers.collected_ids(spark.createDataFrame([("12_x",), ("12_y",), ("13",)], "name string")).collect()} == {"12", "13"}
    assert readers.load_template("﻿a & b &amp; c") == "a &amp; b &amp; c"
    assert readers.load_template("revisionDesc><date>x/date></revisionDesc>") == "<revisionDesc><date>x</date></revisionDesc>"
    (tmp_path / "na.tsv").write_text("a\tb\tc\n1\tNA\tnone\nnan\t2.5\tNone\n")
    typed = readers.read_tsv(spark, str(tmp_path / "na.tsv"), missing=readers.MISSING)
    assert typed.dtypes == [("a", "bigint"), ("b", "double"), ("c", "string")] and [tuple(r) for r in typed.collect()] == [(1, None, "none"), (None, 2.5, None)]
    assert readers.input_path(spark, None, str(tmp_path)) == str(tmp_path) and readers.input_path(spark, str(tmp_path / "na.tsv"), "x").endswith("na.tsv")
    with pytest.raises(FileNotFoundError):
        readers.input_path(spark, str(tmp_path / "nichts"), str(tmp_path))
    assert readers.setting(spark, "QUIRE_NO_SUCH", "d") == "d"
    spark.conf.set("quire.MODEL", "m")
    assert readers.setting(spark, "MODEL") == "m"
    chunks = spark.createDataFrame([("a", "t"), ("b", "t")], "id string, text string")
    assert {tuple(r) for r in readers.gold_or_null(chunks, None).collect()} == {("a", None), ("b", None)} and readers.gold_or_null(chunks, chunks) is chunks


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a/b", "x,1"), (None, "y")], "publisher string, v string")
    sinks.write_csv(df, str(tmp_path / "t"), "\t", single=True)
    assert spark.read.csv(str(tmp_path / "t"), sep="\t", header=True).count() == 2
    sinks.write_by_publisher(df, str(tmp_path / "p"))
    assert {d for d in os.listdir(tmp_path / "p") if d.startswith("publisher")} == {"publisher_dir=a_b", "publisher_dir=unknown"}
    sinks.write_files(spark.createDataFrame([("a.xml", "<a/>"), ("b.xml", None)], "name string, text string"), str(tmp_path / "f"))
    assert sorted(os.listdir(tmp_path / "f")) == ["a.xml", "b.xml"] and (tmp_path / "f" / "a.xml").read_text() == "<a/>"
    for n in (0, 1, 25):
        rows = spark.range(n).selectExpr("id AS k", "IF(id % 2 = 0, concat('z', id), NULL) AS v")
        sinks.write_json_array(rows, str(tmp_path / f"a{n}"), "k")
        text = "".join((tmp_path / f"a{n}" / f).read_text() for f in sorted(os.listdir(tmp_path / f"a{n}")) if f.startswith("part"))
        assert json.loads(text) == [{"k": k, "v": f"z{k}" if k % 2 == 0 else None} for k in range(n)]
    sinks.write_file_folders(spark.createDataFrame([("a.xml", "<a/>"), ("b.xml", None)], "name string, text string"), str(tmp_path / "ff"))
    assert {d for d in os.listdir(tmp_path / "ff") if d.startswith("name")} == {"name=a.xml", "name=b.xml"}
    (tmp_path / "n").mkdir()
    for n in ("a b.epub", "c.epub"):
        (tmp_path / "n" / n).write_text(n)
    plan = readers.epub_plan(spark.createDataFrame([("a b.epub",), ("c.epub",), ("weg.epub",)], "name string"))
    assert sinks.rename_files(plan, str(tmp_path / "n")) == 2 and sinks.rename_files(plan, str(tmp_path / "n")) == 0
    assert {f for f in os.listdir(tmp_path / "n") if f[0] != "."} == {"000001_a_b.epub", "000002_c.epub"} and (tmp_path / "n" / "000002_c.epub").read_text() == "c.epub"
    assert sinks.rename_files(plan, str(tmp_path / "n"), back=True) == 2 and {f for f in os.listdir(tmp_path / "n") if f[0] != "."} == {"a b.epub", "c.epub"}
    log = sinks.mapping_log(spark.createDataFrame([("p", True), ("x", False), ("b", True)], "tag string, handled boolean")).first()["value"]
    assert json.loads(log) == {"handled": ["b", "p"], "unhandled": ["x"]}
    sinks.write_text_report(df, str(tmp_path / "r"), "v")
    sinks.write_json_lines(df, str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "r")).count() == spark.read.json(str(tmp_path / "j")).count() == 2
    n = spark.createDataFrame([("p", 2)], "item string, n int")
    assert {tuple(r) for r in sinks.long_counts(tag=n, cls=n).collect()} == {("p", "tag", 2), ("p", "cls", 2)}


def test_more_names(spark):
    r = spark.createDataFrame([('a<b>:"c/d\\|?*', "x/y/z.json", None)], "p string, q string, n string").select(names.safe_publisher(F.col("p")), names.basename(F.col("q")), names.clean_annotation_text(F.col("n")), names.numeric_or_null(F.lit("1e3")), names.numeric_or_null(F.lit("x"))).first()
    assert tuple(r) == ("a_b___c_d____", "z.json", "", 1000.0, None) and names.column_name("a/b:c") == "a_b_c"


def test_numbers_within_groups(spark):
    rows = [("a", k) for k in range(40)] + [(None, k) for k in range(7)] + [("b", 3)]
    got = numbered_within(spark.createDataFrame(rows, "g string, k int").repartition(5), ["g"], ["k"]).collect()
    assert {(r["g"], r["k"], r["n"]) for r in got} == {(g, k, k + 1 if g != "b" else 1) for g, k in rows}
    assert numbered_within(spark.createDataFrame([], "g string, k int"), ["g"], ["k"]).count() == 0


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://x:7077"

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_names_and_stats(spark):
    df = spark.createDataFrame([('. a/b\\c:d*?"<>|. ', "<p>Es&nbsp;war:3mal</p> einMal &#252;ber &lt;b&gt;Th&uuml;r&amp;")], "n string, t string")
    r = df.select(names.filesystem_safe(F.col("n")).alias("s"), names.clean_annotation_text(F.col("t")).alias("c"), names.safe_title(F.lit("Ä-b! 1  ")).alias("t"), names.escape_commas(F.lit("a,b")).alias("e"), label_key(F.lit(" Title_ page ")).alias("k")).first()
    assert tuple(r) == ("a_b_c-d", "Es war:3 mal ein Mal über Thür&", "Äb 1", "a⟨,⟩b", "title-page")
    chunks = spark.createDataFrame([("a", "f", "<p></p>", "chapter"), ("b", "f", "<p>ä b</p>", "toc"), ("c", "f", None, None)], "id string, source_file string, text string, inferred_type string")
    got = {r["id"]: r for r in textstats.token_stats(chunks).collect()}
    assert (got["a"]["ratio_markup"], got["a"]["tokens_plain"], got["b"]["words_plain"], got["b"]["tokens_plain"], got["b"]["tokens_overhead"], got["b"]["tags_approx"]) == (1.0, 0, 2, 4, 7, 2) and "c" not in got
    assert textstats.largest(textstats.token_stats(chunks)).first()["id"] == "a" and textstats.largest(textstats.token_stats(chunks.limit(0))).count() == 0


def test_lineage_cuts(spark):
    df = cut(spark.range(5).withColumnRenamed("id", "k"), "t")
    assert df.count() == 5 and cut_bytes(df) > 0
    left = spark.range(3).withColumnRenamed("id", "k")
    for limit in (1 << 30, 0):
        assert join_checked(left, df, ["k"], "inner", limit).count() == 3
    drop_cut(df)
    with pytest.raises(Exception):
        df.count()


def test_run_log_and_checks(spark):
    df = spark.createDataFrame([("a", "toc", "Success", None), ("b", None, "Error", "batch_error: x")], "id string, label string, status string, error_message string")
    assert {tuple(r) for r in classify.run_log(df, F.lit("t").alias("x")).collect()} == {("t", "a", "Success", "toc", ""), ("t", "b", "Error", "", "batch_error: x")}
    prompts = spark.createDataFrame([("abc",), ("ä" * 3,)], "prompt string")
    assert [r["over_context"] for r in classify.context_check(prompts, 4, lambda c: F.octet_length(c)).collect()] == [False, True]
    wide = spark.createDataFrame([("1", "toc", None, "x", "y")], "id string, m string, m_subtype string, n string, n_subtype string")
    assert {tuple(r) for r in classify.models_long(wide, ["m", "n"]).collect()} == {("1", "m", "toc", None), ("1", "n", "x", "y")}
    stats = classify.batch_token_stats(spark.createDataFrame([(1, "a"), (3, "a"), (5, "b")], "n int, b string"), F.col("n"), F.col("b")).collect()
    assert {tuple(r) for r in stats} == {("a", 3, 2.0, 4), ("b", 5, 5.0, 5)}
