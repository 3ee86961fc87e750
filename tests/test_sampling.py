from datetime import datetime

from quire.operators import sampling as S

DDL = "id string, title string, publisher string, series string, date_text string, loaded_at timestamp"
T0 = datetime(2025, 1, 1)


def books(spark, rows):
    return spark.createDataFrame([(i, "t", p, s, d, T0) for i, p, s, d in rows], DDL)


def test_boundaries(spark):
    rows = [(f"{p}{k}", p, "?", "1") for p, n in (("a", 4), ("b", 5), ("c", 20), ("d", 21)) for k in range(n)] + [("n", None, None, None)]
    tiers = {r["publisher"]: r["tier"] for r in S.publisher_tiers(books(spark, rows), 5, 20).collect()}
    assert tiers == {"a": "C", "b": "B", "c": "B", "d": "A", None: "Unknown"}
    rows = [(f"{s}{k}", "p", s, "1") for s, n in (("a", 4), ("b", 5), ("c", 20), ("d", 21), ("?", 30)) for k in range(n)]
    sizes = {r["series"]: r["size_category"] for r in S.series_sizes(books(spark, rows), 5, 20).collect()}
    assert sizes == {"a": "Small", "b": "Medium", "c": "Medium", "d": "Large"}
    c = {r["id"]: (r["book_type"], r["size_category"], r["tier"]) for r in S.classify(books(spark, [("x", None, None, None), ("y", "p", "?", None)]), (5, 20), (5, 20)).collect()}
    assert c == {"x": ("Series", "Unknown", "Unknown"), "y": ("Standalone", "N/A", "C")}


def test_temporal_positions(spark):
    rows = [(f"{n}-{k}", "p", f"s{n}", str(2000 - k)) for n in (1, 2, 3, 4, 6, 7) for k in range(n)] + [("u2", "p", "u", "x"), ("u1", "p", "u", None)] + [("v1", "p", "v", "abc"), ("v2", "p", "v", "1990")]
    got = {}
    for r in S.temporal_positions(books(spark, rows)).collect():
        got.setdefault(r["series"], []).append((r["pick"], r["id"], r["temporal_position"]))
    names = {s: [(i, p) for _, i, p in sorted(v)] for s, v in got.items()}
    assert names["s1"] == [("1-0", "only_book")] and names["s2"] == [("2-1", "first"), ("2-0", "last")]
    assert names["s3"] == [("3-2", "first"), ("3-1", "middle"), ("3-0", "last")] and names["s4"] == [("4-3", "first"), ("4-1", "middle"), ("4-0", "last")]
    assert len(names["s6"]) == 3 and names["s7"] == [("7-6", "first"), ("7-3", "middle"), ("7-0", "last"), ("7-5", "quarter_1"), ("7-1", "quarter_3")]
    assert names["u"] == [("u1", "first"), ("u2", "last")] and names["v"] == [("v2", "first"), ("v1", "last")]


def test_quotas():
    q = {(t, s): n for t, s, n in S.quotas(500)}
    assert [q["A", x] for x in ("Large", "Medium", "Small", "N/A")] == [60, 42, 18, 180]
    assert [q["B", x] for x in ("Large", "Medium", "Small", "N/A")] == [25, 17, 7, 75]
    assert [q["C", x] for x in ("Large", "Medium", "Small", "N/A")] == [15, 10, 4, 45]


def test_sample_meets_quotas(spark):
    rows = [(f"L{s}-{k:02}", "big", f"L{s}", str(k)) for s in range(3) for k in range(30)] + [(f"m{s}-{k}", "big", f"M{s}", str(k)) for s in range(2) for k in range(8)] + [(f"s{k}", "big", f"T{k % 20}", "1") for k in range(40)] + [(f"x{k}", "big", "?", "1") for k in range(200)]
    c = S.classify(books(spark, rows), (5, 50), (5, 20))
    got = S.stratified_sample(c, 100).collect()
    n = {}
    for r in got:
        n[r["size_category"]] = n.get(r["size_category"], 0) + 1
    assert n == {"Large": 12, "Medium": 6, "Small": 3, "N/A": 36} or n["N/A"] == 36 and n["Small"] == 3
    assert len({r["id"] for r in got}) == len(got)
    assert S.stratified_sample(c.limit(0), 100).count() == 0


def test_batch_names_and_picks(spark):
    df = spark.createDataFrame([(f"u{k:02}", "f", 0) for k in range(21)] + [("w", "f", 1)], "id string, f string, b int")
    got = {r["id"]: r["batch_name"] for r in S.batch_names(df, "f", "b", ["id"]).collect()}
    assert got["u00"] == "f_book0_part1" and got["u20"] == "f_book0_part2" and got["w"] == "f_book1"
    ids = spark.createDataFrame([(f"i{k}",) for k in range(50)], "id string")
    known = ids.limit(20)
    picked = {r["id"] for r in S.random_pick(ids, known, 10, 1).collect()}
    assert len(picked) == 10 and not picked & {r["id"] for r in known.collect()}


def test_series_and_batches(spark):
    books = spark.createDataFrame([("1", "A"), ("2", "A"), ("2", "A"), ("3", "?"), ("4", None), ("5", "B"), ("9", "C")], "id string, series string")
    sample = spark.createDataFrame([(str(k),) for k in range(1, 6)], "id string")
    assert tuple(S.series_statistics(sample, books).first()) == (2, 3, 1.5)
    assert tuple(S.series_statistics(sample.limit(0), books).first()) == (0, 0, 0.0)
    units = spark.createDataFrame([(f"n{k}", "toc") for k in range(30)] + [(f"c{k}", "chapter") for k in range(30)], "id string, inferred_type string")
    got = S.selection_batches(units, 45, 1, 20, first=3).collect()
    assert len(got) == 45 and sum(r["id"][0] == "n" for r in got) == 30
    assert sorted(r["file_name"] for r in got) == ["gold_chunks_part_03.json"] * 20 + ["gold_chunks_part_04.json"] * 20 + ["gold_chunks_part_05.json"] * 5
    assert len({r["id"][0] for r in got if r["batch"] == 3}) == 2  # shuffled
    rows = spark.createDataFrame([("f", b, k) for b, m in ((0, 20), (1, 21), (None, 3)) for k in range(m)], "file string, book int, k int")
    names = {r["batch_name"] for r in S.batch_names(rows.where("book IS NOT NULL"), "file", "book", ["k"]).collect()}
    assert names == {"f_book0", "f_book1_part1", "f_book1_part2"}
