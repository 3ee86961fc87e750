"""Every core query against its SQL on the smallest tables."""

import glob
import json
import math
import os
import re
from xml.etree import ElementTree

import duckdb
import pandas as pd
import pytest

from quire import catalog
from quire.operators import relabel


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def canon(df):
    df = df[sorted(df.columns)]
    cell = lambda v: "∅" if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)) else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(cell, r)) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, sf, con, name):
    got = catalog.QUERIES[name](spark, sf).toPandas()
    want = con.execute(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


def well_formed(markup):
    return ElementTree.fromstring(f"<r>{markup}</r>")


def check_tei(rows, con):
    texts = dict(con.execute("SELECT id, any_value(text) FROM chunks GROUP BY id HAVING count(*) = 1 AND id IS NOT NULL").fetchall())
    for r in rows:
        if r["tei"] is None:
            assert texts.get(r["id"]) is None
        elif r["id"] in texts:
            # no word is lost or moved into another order
            words = re.findall(r"\w+", re.sub(r"<[^<>]*>", " ", texts[r["id"]]))
            assert re.findall(r"\w+", " ".join(well_formed(r["tei"]).itertext()))[: len(words)] == words


def check_books(rows, con):
    n = con.execute("SELECT count(*) FROM book_json WHERE body IS NOT NULL AND json_valid(body) AND json_type(body) = 'OBJECT'").fetchone()[0]
    got = [well_formed(r["tei"]) for r in rows if r["tei"] is not None]
    assert len(got) == n and all(g[0].find("{*}text/{*}front") is not None and g[0].find("{*}teiHeader") is not None for g in got)


def check_pages(rows, con):
    pages = [r["tei"] for r in rows if r["tei"] is not None]
    assert pages and all(p.startswith("<html>") and p.count("<div") >= p.count('<div class="') for p in pages)


def check_labels(rows, con):
    wanted = {r[0] for r in con.execute("SELECT id FROM eval_results WHERE gold_label IS NOT NULL").fetchall()}
    assert sum(r["n_labelled"] for r in rows) > 0
    for r in rows:
        nodes = [(n, b, c) for holder, k, b, c in relabel.chunk_nodes(json.loads(r["body"])) for n in [holder[k]]] if r["body"].startswith("{") else []
        assert len(nodes) == r["n_labelled"] + r["n_missing"]
        for node, b, c in nodes:
            known = any(re.fullmatch(re.escape(f"{r['source_file']}_{b}_{c}") + "(_.*)?", w) for w in wanted)
            assert (node["true-type"] != "none") == known


def check_volumes(rows, con):
    assert rows and len({(r["record_id"], r["name"]) for r in rows}) == len(rows) and all(re.match(r"\d\d_", r["name"]) and r["html"].startswith("<html>") for r in rows)


CHECKS = {
    "tei_convert": check_tei, "tei_divs": lambda rows, con: [well_formed(r["tei"]) for r in rows], "tei_books": check_books, "html_books": check_pages, "label_books": check_labels, "volume_pages": check_volumes,
    "tei_run_output": lambda rows, con: [well_formed(r["tei"]) for r in rows], "heading_context": lambda rows, con: [r["heading"].index(f"<{r['tag']}") == 0 or 1 / 0 for r in rows],
    "tei_coverage": lambda rows, con: {r["tag"] for r in rows} <= {r[0] for r in con.execute("SELECT DISTINCT lower(unnest(regexp_extract_all(text, '<([A-Za-z][A-Za-z0-9]*)', 1))) FROM chunks").fetchall()} or 1 / 0,
}


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_rows_without_sql(spark, sf, con, name):
    rows = catalog.QUERIES[name](spark, sf).collect()
    assert rows or name == "tei_divs"  # the smallest tables have no div
    CHECKS[name](rows, con)


def test_every_query_has_sql_or_a_check():
    assert set(catalog.QUERIES) == set(catalog.SQL) | set(CHECKS)


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
