import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm.packing import best_fit_decreasing, find_split, lower_bound, pack, report, take_apart
from quire.plans.runtime import read_table

DDL = "doc_id long, text string"


def valid(rows, capacity, sizes):
    fill, places = {}, set()
    for r in rows:
        fill[r["container"]] = fill.get(r["container"], 0) + r["size"]
        assert (r["container"], r["place"]) not in places
        places.add((r["container"], r["place"]))
    assert max(fill.values(), default=0) <= capacity
    total = {}
    for r in rows:
        total.setdefault(r["doc_id"], []).append(r)
    for doc, n in sizes.items():
        own = total[doc]
        assert sum(r["size"] for r in own) == n and sorted(r["part_no"] for r in own) == list(range(1, max(1, -(-n // capacity)) + 1))
    return fill


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=40))
def test_bfd_and_bound(sizes):
    a = np.asarray(sizes, dtype=np.int64)
    bins, place = best_fit_decreasing(a, 100)
    n = int(bins.max()) + 1 if len(a) else 0
    assert all(a[bins == b].sum() <= 100 for b in range(n))
    assert len(set(zip(bins, place))) == len(a)
    v, c = np.unique(a, return_counts=True)
    assert lower_bound(v, c, 100) <= n


def test_bound_beats_volume():
    assert lower_bound(np.array([51]), np.array([7]), 100) == 7
    assert lower_bound(np.array([34]), np.array([6]), 100) == 3


def test_take_apart():
    item, part_no, size = take_apart(np.array([0, 10, 100, 101, 250]), 100)
    assert item.tolist() == [0, 1, 2, 3, 3, 4, 4, 4] and part_no.tolist() == [1, 1, 1, 1, 2, 1, 2, 3] and size.tolist() == [0, 10, 100, 100, 1, 100, 100, 50]


def test_an_exchange_never_costs_containers(spark):
    # sizes that best-fit decreasing packs badly: no exchange may end with more containers than none
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i, "x" * int(n)) for i, n in enumerate(rng.choice([23, 27, 34, 41, 50, 51], 900))], DDL)
    with_, without = ([pack(df, 100, part_items=60, exchange=e).select("container").distinct().count()] for e in (True, False))
    assert with_ <= without


def test_packs_well_and_exchanges(spark):
    rng = np.random.default_rng(3)
    sizes = {i: int(n) for i, n in enumerate(rng.integers(0, 300, 2000))}
    df = spark.createDataFrame([(i, "x" * n) for i, n in sizes.items()], DDL)
    rows = pack(df, 100, part_items=200).collect()
    fill = valid(rows, 100, sizes)
    r = report(pack(df, 100, part_items=200), 100).first()
    assert r["n_containers"] == len(fill) >= r["lower_bound"] and r["n_containers"] <= r["lower_bound"] * 1.01 + 2
    alone = pack(df, 100, part_items=200, exchange=False).select("container").distinct().count()
    assert len(fill) <= alone


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "ä" * 3000), (3, "ä" * 3000), (4, "x" * 4096), (5, "x" * 4097), (6, "y" * 100_000)]
    df = spark.createDataFrame([(*r, 1, "z", 2) for r in rows], DDL + ", size int, container string, part int")
    assert sorted(r[0] for r in find_split(df).collect()) == [3, 5, 6]
    got = pack(df).collect()
    assert {r["doc_id"] for r in got} == {2, 3, 4, 5, 6}
    fill = {}
    for r in got:
        fill[r["container"]] = fill.get(r["container"], 0) + r["size"]
    assert max(fill.values()) <= 4096 and sum(fill.values()) == 12_000 + 4096 + 4097 + 100_000
    assert pack(df.limit(0)).count() == 0 and report(pack(df.limit(0))).first()["n_containers"] == 0


def test_given_tables(spark, sf):
    df = read_table(spark, sf, "documents")
    sizes = {r[0]: r[1] for r in df.selectExpr("doc_id", "octet_length(text)").collect() if r[1] is not None}
    valid(pack(df).collect(), 4096, sizes)
