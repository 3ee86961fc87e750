"""Documents packed whole into containers of fixed capacity: bound-certified repacking.

Documents are spread over parts of bounded size; each part is packed best-fit decreasing, and only there a
document that alone exceeds the capacity is split: its full pieces fill containers of their own, and its rest
is packed like a document. Lower bounds from dual-feasible functions certify a part whose container count
can't be lowered. Parts with a gap exchange the documents of their containers that aren't full: these are
pooled by new parts and packed again; a new part that needs no fewer containers so keeps the old ones. This
goes on until no gap is left, all of them were in one part, or a round closes less than a hundredth of the
gap. A token is one byte of the UTF-8 text.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import byte_tokens
from quire.plans.runtime import cut

CAPACITY = 4096
#: Expected items of a part; a part is packed by one task.
PART_ITEMS = 20_000
#: A round of exchanges that closes less than this share of the gap is the last.
LEAST_CLOSED = 0.01


def lower_bound(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """The best of the volume bound and two families of dual-feasible functions, for sizes with counts.

    f_k: a size above capacity - k counts as capacity, one below k as nothing, others as they are.
    u_k: x (k + 1) / capacity rounded down, but kept if whole, in k-ths of a container.
    """
    keep = sizes > 0
    sizes, counts = sizes[keep].astype(np.int64), counts[keep].astype(np.int64)
    if not len(sizes):
        return 0
    best = int(-(-int((sizes * counts).sum()) // capacity))
    for k in np.unique(sizes[sizes * 2 <= capacity]):
        value = int((np.where(sizes > capacity - k, capacity, np.where(sizes < k, 0, sizes)) * counts).sum())
        best = max(best, -(-value // capacity))
    for k in range(1, 33):
        whole, left = np.divmod(sizes * (k + 1), capacity)
        scaled = np.where(left == 0, sizes * k, whole * capacity)  # in units of capacity * k
        best = max(best, -(-int((scaled * counts).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(container, place) of each item: largest first, each into the fullest container that holds it; ties in input order."""
    n = len(sizes)
    bins, place = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    by_room: dict[int, list[int]] = {}
    rooms: list[int] = []  # sorted rooms that some container has
    from bisect import bisect_left, insort

    held: list[int] = []
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        j = bisect_left(rooms, size)
        if j < len(rooms):
            room = rooms[j]
            own = by_room[room]
            b = heapq.heappop(own)
            if not own:
                del by_room[room]
                del rooms[j]
        else:
            room, b = capacity, len(held)
            held.append(0)
        bins[i], place[i] = b, held[b]
        held[b] += 1
        left = room - size
        if left in by_room:
            heapq.heappush(by_room[left], b)
        else:
            by_room[left] = [b]
            insort(rooms, left)
    return bins, place


def take_apart(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, part_no, size) of the pieces: an item above the capacity gives full pieces and a rest, any other itself."""
    n_parts = np.maximum(1, -(-sizes // capacity))
    item = np.repeat(np.arange(len(sizes)), n_parts)
    part_no = np.arange(len(item)) - np.repeat(np.cumsum(n_parts) - n_parts, n_parts) + 1
    return item, part_no, np.minimum(capacity, sizes[item] - (part_no - 1) * capacity)


def _certified(pdf: pd.DataFrame, bins: np.ndarray, place: np.ndarray, capacity: int, saved: int) -> pd.DataFrame:
    sizes = pdf["size"].to_numpy()
    n_bins = int(bins.max()) + 1 if len(bins) else 0
    fill = np.bincount(bins, weights=sizes, minlength=n_bins).astype(np.int64)
    gap = n_bins - lower_bound(*np.unique(sizes, return_counts=True), capacity)
    return pdf.assign(bin=bins, place=place, gap=gap, fill=fill[bins], saved=saved)[_PACKED_COLUMNS]


def _ordered(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values(["size", "doc_id", "part_no"], ascending=[False, True, True], kind="stable").reset_index(drop=True)


def _pack_part(capacity: int):
    """Whole documents of a part, split where they must be, and packed."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        item, part_no, size = take_apart(pdf["n"].to_numpy(), capacity)
        rows = _ordered(pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[item], "part_no": part_no, "size": size, "part": pdf["part"].to_numpy()[item]}))
        bins, place = best_fit_decreasing(rows["size"].to_numpy(), capacity)
        return _certified(rows, bins, place, capacity, 0)

    return run


def _repack_part(capacity: int):
    """Pooled open containers packed again; the old ones stay unless there are fewer new ones."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = _ordered(pdf)
        bins, place = best_fit_decreasing(rows["size"].to_numpy(), capacity)
        old = pd.factorize(rows["container"])[0].astype(np.int64)
        saved = int(old.max()) - int(bins.max())
        if saved <= 0:
            bins, place = old, rows["place"].to_numpy()
        return _certified(rows, bins, place, capacity, max(0, saved))

    return run


_PACKED_COLUMNS = ["doc_id", "part_no", "size", "part", "bin", "place", "gap", "fill", "saved"]
_PACKED = ", ".join(f"{c} bigint" for c in _PACKED_COLUMNS)


def pack(docs: DataFrame, capacity: int = CAPACITY, part_items: int = PART_ITEMS, exchange: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, part_no, size, container, place): where each document, or part of a split one, lies.

    Null texts lie nowhere; an empty text takes a place but no room. A doc_id given twice is packed twice.
    An empty table gives no rows. Extra columns are not carried.
    """
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), byte_tokens(F.col(text_col)).alias("n")).where("n IS NOT NULL")
    items = cut(sized.withColumn("row", F.monotonically_increasing_id()), "items")
    parts = max(1, -(-items.count() // part_items))
    todo = items.select("doc_id", "n", F.pmod(F.xxhash64("doc_id", "row"), F.lit(parts)).alias("part"))
    packed = cut(todo.groupBy("part").applyInPandas(_pack_part(capacity), _PACKED), "packed")
    done, round_no, gap_before = [], 0, None
    while True:
        by_part = packed.groupBy("part").agg(F.max("gap").alias("gap"), F.max("saved").alias("saved"))
        open_parts, gap, saved = by_part.agg(F.count_if(F.col("gap") > 0), F.sum("gap"), F.sum("saved")).first()
        more = exchange and (open_parts or 0) > 1 and (gap_before is None or saved >= max(1, LEAST_CLOSED * gap_before))
        free = (F.col("gap") > 0) & (F.col("fill") < capacity) if more else F.lit(False)
        named = packed.withColumn("container", F.concat_ws("-", F.lit(str(round_no)), "part", "bin"))
        done.append(named.where(~free).select("doc_id", "part_no", "size", "container", "place"))
        if not more:
            break
        open_ = named.where(free).select("doc_id", "part_no", "size", "container", "place")
        parts = max(1, -(-open_.count() // part_items))
        # whole containers move, so that the old packing of a new part is known
        todo = open_.withColumn("part", F.pmod(F.xxhash64("container"), F.lit(parts)))
        packed = cut(todo.groupBy("part").applyInPandas(_repack_part(capacity), _PACKED), "packed")
        round_no, gap_before = round_no + 1, gap
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out


def report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, room left unused, and the lower bound for all documents together."""
    spark = packed.sparkSession
    sizes = packed.groupBy("size").agg(F.count("*").alias("c")).orderBy("size").collect()  # at most capacity + 1 rows
    bound = lower_bound(np.asarray([r["size"] for r in sizes], dtype=np.int64), np.asarray([r["c"] for r in sizes], dtype=np.int64), capacity)
    by = packed.agg(F.count_distinct("container").alias("n_containers"), F.coalesce(F.sum("size"), F.lit(0)).alias("n_tokens"), F.count("*").alias("n_items"))
    return by.select("n_items", "n_tokens", "n_containers", F.lit(bound).cast("long").alias("lower_bound"), (F.col("n_containers") * capacity - F.col("n_tokens")).alias("unused_tokens"), (F.col("n_containers") == bound).alias("certified"))


def find_split(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id of the documents that the packing laid into more than one container."""
    return pack(docs, capacity).where("part_no > 1").select("doc_id").distinct()
