"""Oversized texts cut into pieces under a token limit, at natural boundaries, with a fixed overlap.

Method of balanced targets: the least number of pieces that can hold the text gives equally spaced
cutting targets; each is moved to the strongest boundary near it; if a piece would break the limit,
one more piece is tried. A token is one byte of the UTF-8 text.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import byte_tokens

#: Boundaries from strong to weak; each pattern ends where the next piece may begin.
_BOUNDARIES = [re.compile(p.encode(), re.S) for p in (
    r"<p[^>]*>\s*\*[\s*]*</p>\s*|\n[ \t]*\*[ *\t]*\n+|</div>\s*|(?=<(?:h[1-6]|head)\b)|(?=\n#{1,6} )",
    r"</(?:p|list|table|ul|ol|pre|item|row|li|tr)>\s*(?=<|\Z)|\n[ \t]*\n\s*",
    r"\n|<(?:lb|br)\b[^>]*>",
    r"[.!?…](?:[\"'”’»«)]|\xe2\x80[\x9c-\x9d]|\xc2[\xab\xbb])*\s+",
    r"[,;:]\s+",
    r"\s+",
)]
#: A boundary is worth moving to within this share of the ideal piece length.
_NEAR = 0.35


def _boundaries(data: bytes) -> list[list[int]]:
    levels, seen = [], set()
    tags = [m.span() for m in re.finditer(rb"<[^<>]*>", data)]
    starts = [a for a, _ in tags]
    for k, pattern in enumerate(_BOUNDARIES):
        own = []
        for m in pattern.finditer(data):
            e = m.end()
            if k > 1 and tags:  # never inside a tag
                j = bisect_right(starts, e) - 1
                if j >= 0 and tags[j][0] < e < tags[j][1]:
                    continue
            if 0 < e < len(data) and e not in seen:
                seen.add(e)
                own.append(e)
        levels.append(own)
    return levels


def _char_start(data: bytes, i: int, low: int) -> int:
    """The last character boundary at or before i, but after low."""
    j = i
    while j > low + 1 and j < len(data) and data[j] & 0xC0 == 0x80:
        j -= 1
    return j


def _snap(data: bytes, levels: list[list[int]], target: int, low: int, high: int, reach: int) -> tuple[int, int]:
    """The strongest boundary near the target in (low, high], and its strength; 0 if there is none."""
    a, z = max(low + 1, target - reach), min(high, target + reach)
    for k, own in enumerate(levels):
        i, j = bisect_left(own, a), bisect_right(own, z)
        if i < j:
            return min(own[i:j], key=lambda e: (abs(e - target), e)), len(levels) - k
    return _char_start(data, min(max(target, low + 1), high), low), 0


def cut_points(data: bytes, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, strength of the end) of each piece: starts overlap tokens before the last end (moved to a
    character boundary), and no piece is longer than limit. Text under the limit is one piece; empty text none."""
    if not data:
        return []
    n = len(data)
    if n <= limit:
        return [(0, n, 0)]
    if not 0 <= overlap < limit - 4:
        raise ValueError("the overlap must be at least 4 tokens smaller than the limit")
    levels, step = _boundaries(data), limit - overlap
    count = -(-(n - overlap) // step)
    while True:
        ends, strengths, start, ok = [], [], 0, True
        even = (n + (count - 1) * overlap) / count  # length of equal pieces
        for k in range(1, count):
            target = round(k * (even - overlap) + overlap)
            high = min(start + limit, n - 1)
            low = max(start + overlap, ends[-1] if ends else 0)
            # what is left must fit into the remaining pieces
            low = max(low, n - (count - k) * step - 4 * (count - k)) if count > 1 else low
            if low >= high:
                ok = False
                break
            end, strength = _snap(data, levels, min(max(target, low + 1), high), low, high, max(1, round(even * _NEAR)))
            ends.append(end)
            strengths.append(strength)
            start = _char_start(data, max(end - overlap, 0), start)
        if ok and n - start <= limit:
            ends.append(n)
            strengths.append(len(levels) + 1)
            out, start = [], 0
            for end, strength in zip(ends, strengths):
                out.append((start, end, strength))
                start = _char_start(data, max(end - overlap, 0), start)
            if all(e - s <= limit for s, e, _ in out):
                return out
        count += 1


_PIECES = pa.schema([("id", pa.string()), ("text_hash", pa.int64()), ("n_tokens", pa.int64()), ("n_pieces", pa.int64()), ("piece_no", pa.int64()), ("start_token", pa.int64()), ("end_token", pa.int64()), ("overlap_tokens", pa.int64()), ("boundary", pa.int64()), ("piece_text", pa.string())])
_PIECES_DDL = "id string, text_hash bigint, n_tokens bigint, n_pieces bigint, piece_no bigint, start_token bigint, end_token bigint, overlap_tokens bigint, boundary bigint, piece_text string"


def _cutter(limit: int, overlap: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for id_, key, text in zip(*(b.column(k).to_pylist() for k in ("id", "text_hash", "text"))):
                data = text.encode("utf-8")
                points, before = cut_points(data, limit, overlap), 0
                for k, (s, e, strength) in enumerate(points, 1):
                    rows.append((id_, key, len(data), len(points), k, s, e, max(0, before - s), strength, data[s:e].decode("utf-8") if with_text else None))
                    before = e
            yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*rows) if rows else ([],) * 10, _PIECES.types)], schema=_PIECES)

    return run


def _oversized(chunks: DataFrame, limit: int, id_col: str, text_col: str) -> DataFrame:
    rows = chunks.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where(byte_tokens(F.col("text")) > limit)
    return rows.select("id", F.xxhash64("text").alias("text_hash"), "text")


def split_oversized(chunks: DataFrame, limit: int, overlap: int, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Ordered pieces of every text with more than limit tokens, once for each different (id, text).

    Null texts and texts within the limit give no rows; an id given again with the same text is cut once,
    with another text it has pieces for each. Very long texts are cut whole. Extra columns are not carried.
    """
    rows = _oversized(chunks, limit, id_col, text_col).groupBy("id", "text_hash").agg(F.first("text").alias("text"))
    return rows.select("id", "text_hash", "text").mapInArrow(_cutter(limit, overlap, True), _PIECES_DDL)


def window_overlap(token_windows: DataFrame, window: int) -> int:
    """The overlap that token_windows (four rows) gives for a window; 0 if it has none."""
    row = token_windows.where(F.col("window_tokens") == window).agg(F.max("overlap_tokens").alias("o")).first()
    return int(row["o"] or 0)


def find_oversized(chunks: DataFrame, token_windows: DataFrame, window: int = 8192) -> DataFrame:
    """Ids of the chunks that had to be cut. Texts are cut where they are read; only ids are moved."""
    pieces = _oversized(chunks, window, "id", "text").mapInArrow(_cutter(window, window_overlap(token_windows, window), False), _PIECES_DDL)
    return pieces.where("n_pieces > 1 AND piece_no = 1").select("id").distinct()
