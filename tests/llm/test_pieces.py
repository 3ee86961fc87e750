from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm.pieces import cut_points, find_oversized, split_oversized

PARA = "<p>Ein Satz steht hier. Noch ein Satz, etwas länger als der erste.</p>\n"


def check(data, limit, overlap):
    points = cut_points(data, limit, overlap)
    assert points[0][0] == 0 and points[-1][1] == len(data)
    joined, before = b"", 0
    for s, e, _ in points:
        assert 0 < e - s <= limit and s <= before
        data[s:e].decode("utf-8")
        joined += data[before:e]
        before = e
    assert joined == data
    for (_, e, _), (s, _, _) in zip(points, points[1:]):
        assert overlap <= e - s < overlap + 4
    return points


@settings(max_examples=200, deadline=None)
@given(st.text(min_size=1, max_size=600), st.integers(20, 90), st.integers(0, 10))
def test_any_text_is_covered(text, limit, overlap):
    try:
        data = text.encode("utf-8")
    except UnicodeEncodeError:
        return
    check(data, limit, overlap) if len(data) > limit else None


def test_cuts_at_paragraphs():
    data = (PARA * 40).encode()
    points = check(data, 1000, 50)
    assert all(data[:e].rstrip().endswith(b"</p>") for _, e, _ in points)
    lengths = [e - s for s, e, _ in points]
    assert max(lengths) - min(lengths) < 350  # balanced, no small rest


def test_strong_boundary_wins():
    data = (PARA * 9 + "<p>* * *</p>\n" + PARA * 11).encode()
    s, e, strength = cut_points(data, 1000, 0)[0]
    assert strength == 6 and data[:e].rstrip().endswith(b"* * *</p>")


def test_one_unbroken_word():
    check(b"x" * 10_000, 999, 100)
    check("ß".encode() * 5_000, 1000, 101)


def test_edges(spark):
    rows = [("a", "kurz"), ("b", "wort " * 3000), ("b", "wort " * 3000), ("c", None), ("d", ""), (None, "wort " * 3000), ("e", "x" * 8192), ("f", "x" * 8193), ("g", "ä" * 4097)]
    chunks = spark.createDataFrame([(*r, 1, "z") for r in rows], "id string, text string, n_tokens int, text_hash string")
    windows = spark.createDataFrame([(8192, 512)], "window_tokens long, overlap_tokens long")
    assert {r[0] for r in find_oversized(chunks, windows).collect()} == {None, "b", "f", "g"}
    got = split_oversized(chunks, 8192, 512).collect()
    b = sorted((r for r in got if r["id"] == "b"), key=lambda r: r["piece_no"])
    assert [r["piece_no"] for r in b] == [1, 2] and b[1]["overlap_tokens"] >= 512
    assert "".join(r["piece_text"][r["overlap_tokens"]:] for r in b) == "wort " * 3000
    empty = spark.createDataFrame([], "id string, text string")
    assert split_oversized(empty, 8192, 512).count() == 0
    assert find_oversized(chunks, spark.createDataFrame([], "window_tokens long, overlap_tokens long")).count() == 4
