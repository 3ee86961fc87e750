"""Sources mixed to target shares of the total size: min-cost flow over membership patterns.

Documents with the same content belong to the same class; a class's pattern is the set of sources
that hold it. Token capacity flows from patterns to the quotas of the sources. A source's edge holds
its tokens of the pattern times its cap on repetition; each further use of a pattern's content costs
more than the last, so the flow repeats little and spreads over sources that overlap. The flow of each
pattern and source is then turned into whole documents, taken in seeded order. A token is one byte
of the UTF-8 text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import byte_tokens, source_key
from quire.llm.seeded import take_by_hash
from quire.plans.runtime import cut, join_checked


def min_cost_flow(cells: Sequence[tuple[int, int, int]], units: Sequence[int], quotas: Sequence[int]) -> list[int]:
    """Flow on each cell (pattern, source, capacity) of a maximum flow to the quotas of least cost.

    The k-th use of a pattern's `units` tokens costs k - 1 a token; all other edges are free. So every path costs
    what the use it starts from costs, and successive shortest paths go through the uses from cheap to dear. A path
    may take from a source what another one can't get elsewhere: it then runs through the pattern both share.
    """
    of_pattern: list[list[int]] = [[] for _ in units]
    of_source: list[list[int]] = [[] for _ in quotas]
    for c, (p, s, _) in enumerate(cells):
        of_pattern[p].append(c)
        of_source[s].append(c)
    flow, room = [0] * len(cells), list(quotas)
    held = [sum(cells[c][2] for c in own) for own in of_pattern]
    closed = [False] * len(quotas)  # sources from which no path leads to a quota with room; this never changes again

    def path(p: int) -> list[tuple[int, int]] | None:
        """Cells to fill and to take from on a shortest path from the pattern to a quota with room."""
        came: dict[int, tuple[int, int | None]] = {}
        todo = []
        for c in of_pattern[p]:
            s = cells[c][1]
            if flow[c] < cells[c][2] and s not in came and not closed[s]:
                came[s] = (c, None)
                todo.append(s)
        for s in todo:
            if room[s] > 0:
                steps = []
                while True:
                    fill, taken = came[s]
                    steps.append((fill, +1))
                    if taken is None:
                        return steps
                    steps.append((taken, -1))
                    s = cells[taken][1]
            for taken in of_source[s]:
                if flow[taken] > 0:
                    for c in of_pattern[cells[taken][0]]:
                        t = cells[c][1]
                        if t not in came and not closed[t] and flow[c] < cells[c][2]:
                            came[t] = (c, taken)
                            todo.append(t)
        for s in todo:
            closed[s] = True
        return None

    live = [p for p in range(len(units)) if held[p] > 0]
    while live:
        later = []
        for p in live:  # one use of each pattern's content
            left, stuck = min(units[p], held[p]), False
            while left > 0:
                steps = path(p)
                if steps is None:
                    stuck = True
                    break
                push = min([left, room[cells[steps[0][0]][1]], *(cells[c][2] - flow[c] if sign > 0 else flow[c] for c, sign in steps)])
                for c, sign in steps:
                    flow[c] += sign * push
                room[cells[steps[0][0]][1]] -= push
                held[p] -= push
                left -= push
            if held[p] > 0 and not stuck:
                later.append(p)
        live = later
    return flow


def _classed(docs: DataFrame) -> DataFrame:
    """(doc_id, source, tokens, content) of the documents with non-empty text. Texts are the same content if their
    letters and digits agree, whatever their case, blanks and marks; without letters and digits, if all agrees."""
    text = F.col("text")
    plain = F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))
    return docs.where(text.isNotNull() & (text != "")).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(source_key(F.col("source")), F.lit("")).alias("source"), byte_tokens(text).alias("tokens"),
        F.xxhash64(F.when(plain != "", plain).otherwise(text)).alias("content"),
    )


def _targets(targets: DataFrame) -> DataFrame:
    return targets.select(F.col("source").alias("target_source"), source_key(F.col("source")).alias("source"), "target_permille", "max_repeats").where("source IS NOT NULL")


def source_capacity(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(source as in the targets, target_permille, max_repeats, n_docs, tokens, total_tokens, quota_tokens, reachable)."""
    sized = docs.select(F.coalesce(source_key(F.col("source")), F.lit("")).alias("source"), byte_tokens(F.col("text")).alias("t")).where("t IS NOT NULL")
    by = cut(sized.groupBy("source").agg(F.sum("t").alias("tokens"), F.count("*").alias("n_docs")), "sources")
    total = int(by.agg(F.sum("tokens")).first()[0] or 0)
    joined = _targets(targets).join(by, "source", "left").fillna(0, ["tokens", "n_docs"])
    return joined.select(
        F.col("target_source").alias("source"), "target_permille", "max_repeats", "n_docs", "tokens", F.lit(total).cast("long").alias("total_tokens"),
        F.floor(F.col("target_permille") * total / 1000).cast("long").alias("quota_tokens"),
        (F.col("tokens") * F.col("max_repeats") * 1000 >= F.col("target_permille") * F.lit(total)).alias("reachable"),
    )


def route(classed: DataFrame, targets: DataFrame, total: int) -> tuple[DataFrame, DataFrame, list[tuple[str, int, int]]]:
    """Documents with their cell (pattern and source), the tokens to take of each cell, and (source, need, flow).

    The driver holds one row per pattern and source in it; there are never more patterns than sets of wanted sources.
    A target without share or cap on repetition is none.
    """
    spark = classed.sparkSession
    wanted = cut(_targets(targets).where("target_permille IS NOT NULL AND max_repeats IS NOT NULL"), "targets")
    docs = classed.join(wanted.select("source", "max_repeats"), "source", "left_semi")
    # only classes held by several sources have a pattern of their own
    multi = docs.groupBy("content").agg(F.sort_array(F.collect_set("source")).alias("members"), F.min("tokens").alias("unit")).where("size(members) > 1")
    multi = cut(multi.select("content", F.array_join("members", "\x1f").alias("pattern"), "unit"), "multi")
    units = {r["pattern"]: int(r["u"]) for r in multi.groupBy("pattern").agg(F.sum("unit").alias("u")).collect()}
    docs = join_checked(docs, cut(multi.select("content", "pattern"), "content"), ["content"], "left")
    docs = docs.select("doc_id", "source", "tokens", F.concat_ws("\x1e", F.coalesce("pattern", F.lit("")), "source").alias("cell"))
    docs = cut(docs, "cells")
    held = sorted((r["cell"], int(r["tokens"])) for r in docs.groupBy("cell").agg(F.sum("tokens").alias("tokens")).collect())
    # the least whole number of tokens that reaches the target
    quota = {r["source"]: (-(-int(r["target_permille"]) * total // 1000), int(r["max_repeats"])) for r in wanted.collect()}
    sources, patterns = {s: i for i, s in enumerate(sorted(quota))}, {}
    cells, sizes = [], []
    for cell, tokens in held:
        pattern, source = cell.split("\x1e")
        key = pattern or cell  # what one source alone holds is a pattern, too
        if key not in patterns:
            patterns[key] = len(sizes)
            sizes.append(units.get(pattern, tokens))
        cells.append((patterns[key], sources[source], tokens * quota[source][1]))
    flow = min_cost_flow(cells, sizes, [max(0, quota[s][0]) for s in sources])
    rows, got = [], dict.fromkeys(sources, 0)
    for (cell, tokens), f in zip(held, flow):
        source = cell.split("\x1e")[1]
        rows.append((cell, source, tokens, f))
        got[source] += f
    plan = spark.createDataFrame(rows, "cell string, source string, cell_tokens bigint, flow bigint")
    return docs, plan, [(s, quota[s][0], got[s]) for s in sources]


def _top_up(rows: DataFrame, taken: DataFrame, quotas: DataFrame) -> DataFrame:
    """What seeded order left of a cell's quota, filled by the largest documents that still fit, until none does."""
    while True:
        used = taken.groupBy("cell").agg(F.sum("tokens").alias("used"))
        room = quotas.join(used, "cell", "left").select("cell", (F.col("quota") - F.coalesce("used", F.lit(0))).alias("room")).where("room > 0")
        fits = join_checked(rows, cut(room, "room"), ["cell"], "inner").where(F.col("tokens") <= F.col("room"))
        fits = fits.join(taken.select("row"), "row", "left_anti")
        best = fits.groupBy("cell").agg(F.max(F.struct("tokens", "row")).alias("b")).select(F.col("b.row").alias("row"), "cell", F.col("b.tokens").alias("tokens"))
        best = cut(best, "best")
        if best.isEmpty():
            return taken
        taken = taken.unionByName(best)


def mix(docs: DataFrame, targets: DataFrame, seed: int = 42) -> DataFrame:
    """(doc_id, source, tokens, repeats) of every document of a wanted source: how often it is used, 0 included.

    A document is used at most max_repeats times. Null and empty texts have no tokens and aren't listed.
    A source given no target, or unknown to the targets, isn't used. A repeated doc_id is listed again.
    """
    classed = cut(_classed(docs), "classed")
    total = int(docs.agg(F.sum(byte_tokens(F.col("text")))).first()[0] or 0)
    rows, plan, _ = route(classed, targets, total)
    plan = cut(plan.where("cell_tokens > 0").withColumn("whole", F.floor(F.col("flow") / F.col("cell_tokens")).cast("long")).withColumn("quota", F.col("flow") - F.col("whole") * F.col("cell_tokens")), "plan")
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    extra = take_by_hash(rows, "cell", "row", "tokens", plan.where("quota > 0").select("cell", "quota"), seed)
    extra = _top_up(rows, cut(extra.select("row", "cell", "tokens"), "extra"), plan.where("quota > 0").select("cell", "quota"))
    extra = extra.select("row", F.lit(1).cast("long").alias("extra"))
    out = join_checked(rows, cut(plan.select("cell", "whole"), "whole"), ["cell"], "inner").join(extra, "row", "left")
    return out.select("doc_id", "source", "tokens", (F.col("whole") + F.coalesce("extra", F.lit(0))).alias("repeats"))


def shares(docs: DataFrame, targets: DataFrame, seed: int = 42) -> DataFrame:
    """source_capacity with what the mix reached: used_tokens, max_used, and the share in the mix
    (actual_permille) and in the size aimed at (permille_of_total)."""
    used = mix(docs, targets, seed).groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("used_tokens"), F.max("repeats").alias("max_used"))
    used = cut(used, "used")
    total = int(used.agg(F.sum("used_tokens")).first()[0] or 0)
    out = source_capacity(docs, targets).withColumn("key", source_key(F.col("source"))).join(used.withColumnRenamed("source", "key"), "key", "left").drop("key").fillna(0, ["used_tokens", "max_used"])
    return out.withColumn("actual_permille", F.col("used_tokens") * 1000.0 / max(total, 1)).withColumn("permille_of_total", F.col("used_tokens") * 1000.0 / F.greatest("total_tokens", F.lit(1)))


def find_short_sources(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """Sources (as in the targets) whose quota the flow doesn't fill: all they hold, repeated as allowed, is too little."""
    classed = cut(_classed(docs), "classed")
    total = int(docs.agg(F.sum(byte_tokens(F.col("text")))).first()[0] or 0)
    _, _, reached = route(classed, targets, total)
    short = [(source,) for source, need, flow in reached if flow < need]
    rows = docs.sparkSession.createDataFrame(short, "source string")
    return _targets(targets).join(rows, "source", "left_semi").select(F.col("target_source").alias("source"))
