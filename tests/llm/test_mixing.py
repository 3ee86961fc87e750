from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm.mixing import find_short_sources, min_cost_flow, mix, shares
from quire.llm.seeded import take_by_hash
from quire.plans.runtime import read_table

DOCS = "doc_id long, text string, source string"
TARGETS = "source string, target_permille long, max_repeats long"


def cheapest(cells, units, quotas):
    """(flow to the quotas, cost) by successive shortest paths over the whole network, one token at a time."""
    held = [sum(c[2] for c in cells if c[0] == p) for p in range(len(units))]
    edges = []  # [from, to, capacity, cost]
    for p, (unit, left) in enumerate(zip(units, held)):
        for use in range(left and -(-left // unit)):
            edges.append(["in", ("p", p), min(unit, left - use * unit), use])
    edges += [[("p", p), ("s", s), cap, 0] for p, s, cap in cells] + [[("s", s), "out", q, 0] for s, q in enumerate(quotas)]
    edges = [x for e in edges for x in (e, [e[1], e[0], 0, -e[3]])]
    total = cost = 0
    while True:
        dist, via = {"in": 0}, {}
        for _ in range(len(units) + len(quotas) + 2):
            for k, (u, v, cap, c) in enumerate(edges):
                if cap > 0 and u in dist and dist[u] + c < dist.get(v, 10**9):
                    dist[v], via[v] = dist[u] + c, k
        if "out" not in dist:
            return total, cost
        v = "out"
        while v != "in":
            k = via[v]
            edges[k][2] -= 1
            edges[k ^ 1][2] += 1
            v = edges[k][0]
        total, cost = total + 1, cost + dist["out"]


def check_flow(cells, units, quotas):
    flow = min_cost_flow(cells, units, quotas)
    assert all(0 <= f <= c[2] for f, c in zip(flow, cells))
    used = [sum(f for f, c in zip(flow, cells) if c[0] == p) for p in range(len(units))]
    assert all(sum(f for f, c in zip(flow, cells) if c[1] == s) <= q for s, q in enumerate(quotas))
    cost = sum(max(0, x - unit * k) for x, unit in zip(used, units) for k in range(1, 60))
    assert (sum(flow), cost) == cheapest(cells, units, quotas)


def test_flow_takes_a_way_through_a_shared_pattern():
    # the second source can only be served if the first gives back what both share
    check_flow([(0, 0, 4), (0, 1, 4), (1, 0, 4)], [4, 4], [4, 4])
    check_flow([], [], [3])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3), st.integers(0, 9)), max_size=10, unique_by=lambda c: c[:2]), st.lists(st.integers(1, 5), min_size=4, max_size=4), st.lists(st.integers(0, 12), min_size=4, max_size=4))
def test_flow_is_as_large_and_cheap_as_can_be(cells, units, quotas):
    check_flow(cells, units, quotas)


def test_mix_reaches_the_shares(spark):
    rows = [(i, f"dokument {i} " + "wort " * (i % 40), "A") for i in range(300)] + [(1000 + i, f"kleines dokument {i} " + "x" * 60, " b") for i in range(20)]
    docs = spark.createDataFrame(rows, DOCS)
    targets = spark.createDataFrame([("a", 700, 1), ("B", 60, 3), ("c", 100, 2)], TARGETS)
    total = sum(len(t.encode()) for _, t, _ in rows)
    got = mix(docs, targets).collect()
    assert len(got) == 320
    for s, permille, most in (("a", 700, 1), ("b", 60, 3)):
        own = [r for r in got if r["source"] == s]
        used, quota = sum(r["tokens"] * r["repeats"] for r in own), -(-permille * total // 1000)
        assert max(r["repeats"] for r in own) <= most and used <= quota and used > quota - 150
    rep = {r["source"]: r for r in shares(docs, targets).collect()}
    assert rep["c"]["used_tokens"] == 0 and not rep["c"]["reachable"] and rep["a"]["reachable"]
    assert {r[0] for r in find_short_sources(docs, targets).collect()} == {"c"}
    assert {(r["doc_id"], r["repeats"]) for r in got} == {(r["doc_id"], r["repeats"]) for r in mix(docs, targets).collect()}


def test_overlapping_sources_repeat_little(spark):
    shared = [(i, "gemeinsamer text nummer %d " % i + "wort " * 50, s) for i in range(40) for s in ("a", "b")]
    own = [(100 + i, "eigener text nummer %d " % i + "wort " * 50, "a") for i in range(40)]
    docs = spark.createDataFrame([(k, t, s) for k, (_, t, s) in enumerate(shared + own)], DOCS)
    targets = spark.createDataFrame([("a", 300, 1), ("b", 300, 1)], TARGETS)
    by = {"a": {0: 0, 1: 0}, "b": {0: 0, 1: 0}}
    for r in mix(docs, targets).collect():
        by[r["source"]][int(r["doc_id"] < 80)] += r["tokens"] * r["repeats"]
    assert by["a"][0] > by["a"][1]  # a gives its own texts first, b needs the shared ones


def test_short_sources_come_from_the_flow(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "x" * 60, "a"), (2, "y" * 40, "b")], DOCS)
    targets = spark.createDataFrame([("a", 600, 1), ("b", 401, 1), ("c", None, 1), ("d", 1, None)], TARGETS)
    assert {r[0] for r in find_short_sources(docs, targets).collect()} == {"b"}
    monkeypatch.setattr("quire.llm.mixing.min_cost_flow", lambda cells, units, quotas: [0] * len(cells))
    assert {r[0] for r in find_short_sources(docs, targets).collect()} == {"a", "b"}


def test_seeded_take(spark):
    rows = spark.createDataFrame([(i, "x" if i % 3 else "y", 2) for i in range(3000)], "k long, c string, w int")
    quotas = spark.createDataFrame([("x", 1001), ("y", 0)], "c string, quota long")
    got = take_by_hash(rows, "c", "k", "w", quotas, 5).collect()
    assert sum(r["w"] for r in got) == 1000 and {r["c"] for r in got} == {"x"} and len({r["k"] for r in got}) == 500


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x" * 500_000, None), (4, "text", "a"), (4, "text", "a"), (5, "text", "zzz")]
    docs = spark.createDataFrame([(*r, 1, "q", "w") for r in rows], DOCS + ", tokens int, cell string, quota string")
    targets = spark.createDataFrame([("a", 1, 2), (None, 5, 1)], TARGETS)
    assert sorted(r["doc_id"] for r in mix(docs, targets).collect()) == [4, 4]
    assert {r[0] for r in find_short_sources(docs, targets).collect()} == {"a"}
    assert mix(docs.limit(0), targets).count() == 0 and mix(docs, targets.limit(0)).count() == 0


def test_given_tables(spark, sf):
    docs, targets = read_table(spark, sf, "documents"), read_table(spark, sf, "mix_targets")
    caps = {r["source"]: r["max_repeats"] for r in targets.collect()}
    assert all(0 <= r["repeats"] <= caps[r["source"]] for r in mix(docs, targets).collect())
