from collections import Counter
from datetime import datetime

import numpy as np

from quire.llm import stratified as S
from quire.plans.runtime import read_table

BOOKS = "id string, publisher string, series string, publisher_tier string, series_size_category string, loaded_at timestamp"
TARGETS = "publisher_tier string, series_size_category string, target_pct long, min_books long"
T0 = datetime(2025, 1, 1)


def books(spark, rows):
    return spark.createDataFrame([(i, p, s, t, c, T0) for i, p, s, t, c in rows], BOOKS)


def test_shares_and_floors(spark):
    rows = [(f"a{k}", f"P{k % 3}", "?", "A", "N/A") for k in range(600)] + [(f"b{k}", "P9", "S", " b", "large ") for k in range(300)] + [(f"c{k}", "P8", "?", "C", "N/A") for k in range(4)] + [(f"z{k}", "P7", "?", None, None) for k in range(96)]
    df, targets = books(spark, rows), spark.createDataFrame([("A", "N/A", 50, 5), ("B", "Large", 40, 5), ("C", "N/A", 5, 6), ("D", "Small", 5, 1)], TARGETS)
    got = S.draw_sample(df, targets).collect()
    assert len(got) == 100 and len({r["id"] for r in got}) == 100
    c = Counter(r["id"][0] for r in got)
    # what C and D can't give is the rest's
    assert c["c"] == 4 and c["a"] >= 50 and c["b"] >= 40 and c["a"] + c["b"] <= 96
    rep = {r["publisher_tier"]: r for r in S.strata_report(df, targets).collect()}
    assert (rep["C"]["n_books"], rep["C"]["need"], rep["C"]["below_need"]) == (4, 6, True) and rep["D"]["below_need"] and not rep["A"]["below_need"]
    assert {r[0] for r in S.find_short_strata(df, targets).collect()} == {"C", "D"}
    again = S.draw_sample(df, targets).collect()
    assert {r["id"] for r in got} == {r["id"] for r in again}


def test_swaps_reach_the_targets():
    rng = np.random.default_rng(0)
    members = np.eye(3, dtype=np.int64)[rng.integers(0, 3, 60)]
    available = rng.integers(5, 50, 60)
    side = [rng.integers(0, 4, 60)]
    targets = np.array([50.0, 30.0, 20.0])
    have = S.swap_repair(available, members, side, np.array([5, 5, 5]), targets, 100, 1)
    assert have.sum() == 100 and (have <= available).all() and (have >= 0).all()
    assert np.abs(have @ members - targets).sum() <= 2


def improving(have, available, members, side, floors, targets, k):
    """The best change of the deviation by one exchange, every pair of signatures tried."""
    goals = [np.bincount(c, weights=available, minlength=c.max() + 1) * k / available.sum() for c in side]
    floors = np.minimum(floors, available @ members)

    def deviation(h):
        return np.abs(h @ members - targets).sum() + S.SIDE_WEIGHT * sum(np.abs(np.bincount(c, weights=h, minlength=len(g)) - g).sum() for c, g in zip(side, goals))

    best = 0.0
    for a in np.flatnonzero(have < available):
        for d in np.flatnonzero(have > 0):
            one = have.copy()
            one[a] += 1
            one[d] -= 1
            if (one @ members >= floors).all():
                best = min(best, deviation(one) - deviation(have))
    return best


def test_swaps_end_only_when_none_helps():
    rng = np.random.default_rng(3)
    # 150 signatures without a stratum cost least by themselves; those of a stratum help only within it
    for floor in (5, 60):
        kind = np.r_[np.full(150, 3), rng.integers(0, 3, 150)]
        members = np.vstack([np.eye(3, dtype=np.int64), np.zeros((1, 3), dtype=np.int64)])[kind]
        members[-9:, 0] = 1  # some in several strata
        available = rng.integers(1, 6, 300)
        side = [rng.integers(0, 12, 300), rng.integers(0, 25, 300)]
        floors, targets = np.array([floor] * 3), np.array([30.0, 20.0, 10.0])
        have = S.swap_repair(available, members, side, floors, targets, 100, 1)
        assert (have @ members >= np.minimum(floors, available @ members)).all() and have.sum() >= 100
        assert improving(have, available, members, side, floors, targets, 100) > -1e-9


def test_one_id_in_several_strata(spark):
    df = books(spark, [("x", "P", "?", "A", "N/A"), ("x", "P", "?", "B", "N/A"), ("x", "P", "?", "B", "N/A")] + [(f"k{i}", "P", "?", "A", "N/A") for i in range(19)])
    targets = spark.createDataFrame([("A", "N/A", 50, 1), ("B", "N/A", 50, 1)], TARGETS)
    rep = {r["publisher_tier"]: r["n_books"] for r in S.strata_report(df, targets).collect()}
    assert rep == {"A": 20, "B": 1}


def test_short_strata_are_those_the_repair_leaves_short(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(f"i{k}", f"P{k % 7}", f"S{k % 11}", "ABC"[min(2, int(rng.exponential()))], ("Large", "Small")[k % 2]) for k in range(400)]
    rows += [(f"i{k}", "P1", "S1", "C", "Small") for k in range(0, 40, 3)]  # in two strata
    df = books(spark, rows)
    targets = spark.createDataFrame([(t, c, pct, least) for (t, c), pct, least in zip([(t, c) for t in "ABC" for c in ("Large", "Small")], (20, 20, 20, 20, 15, 5), (3, 70, 60, 5, 90, 8))], TARGETS)
    held = {(t, c): len({i for i, _, _, x, y in rows if (x, y) == (t, c)}) for t, c in [(t, c) for t in "ABC" for c in ("Large", "Small")]}
    k = len({r[0] for r in rows}) // 10
    wanted = {(r[0], r[1]) for r in targets.collect() if held[r[0], r[1]] < max(r[3], -(-r[2] * k // 100))}
    assert wanted and {tuple(r) for r in S.find_short_strata(df, targets).collect()} == wanted
    monkeypatch.setattr(S, "swap_repair", lambda available, *a: np.zeros(len(available), dtype=np.int64))
    assert S.find_short_strata(df, targets).count() == 6


def test_the_start_draws_as_many_as_asked():
    rng = np.random.default_rng(2)
    for n in (1, 7, 300):
        available = rng.integers(0, 9, n)
        for k in (0, 1, int(available.sum()) // 2, int(available.sum())):
            have = S.swap_repair(available, np.zeros((n, 1), dtype=np.int64), [np.zeros(n, dtype=np.int64)], np.array([0]), np.array([0.0]), k, 3)
            assert have.sum() == k and (have <= available).all()
    big = np.array([3 * 10**9, 10**10, 7])
    have = S.swap_repair(big, np.eye(3, dtype=np.int64), [np.zeros(3, dtype=np.int64)], np.array([1, 1, 7]), np.array([10**9 * 0.3, 10.0**9, 1]), 1_300_000_000, 3)
    assert have.sum() == 1_300_000_000 and (have <= big).all() and have[2] == 7


def test_edges(spark):
    targets = spark.createDataFrame([("A", "N/A", 100, 1), (None, "N/A", 0, 0)], TARGETS)
    empty = books(spark, [])
    assert S.draw_sample(empty, targets).count() == 0
    assert [tuple(r) for r in S.find_short_strata(empty, targets).collect()] == [("A", "N/A")]
    df = books(spark, [(None, None, None, None, None)] + [(f"i{k}", None, None, "a", "n/a") for k in range(30)]).selectExpr("*", "1 AS stratum", "2 AS signature", "3 AS one")
    assert S.draw_sample(df, targets).count() == 3
    assert S.draw_sample(df, targets.limit(0)).count() == 3


def test_given_tables(spark, sf):
    df, targets = read_table(spark, sf, "sample_data"), read_table(spark, sf, "sample_targets")
    n, k = S.draw_sample(df, targets).count(), df.select("id").distinct().count() // 10
    report = S.strata_report(df, targets).collect()
    assert n >= k and all(r["n_sampled"] >= min(r["min_books"], r["n_books"]) for r in report)
    if n > k:  # the floors alone need more than a tenth of the books
        assert sum(min(r["min_books"], r["n_books"]) for r in report) > k
