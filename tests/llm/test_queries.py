import pytest

from quire.llm.queries import QUERIES, SQL

FOUND = {"p1_found": ["doc_id"], "p2_found": ["id"], "p3_found": ["origin", "item_id", "line_no"], "p4_found": ["id", "consensus_label"], "p5_found": ["publisher_tier", "series_size_category"], "p7_found": ["doc_id"], "p8_found": ["source"], "p9_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(FOUND))
def test_columns_and_unique_rows(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.columns == FOUND[name]
    rows = df.collect()
    assert rows and len(rows) == len(set(rows))


def test_sql_names():
    assert set(SQL) <= set(QUERIES)
