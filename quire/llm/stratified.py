"""A sample with given shares per category and a floor for small ones: swap repair over signatures.

Records are grouped by signature (stratum memberships, publisher, series). A random sample that meets
the floors is drawn as counts per signature; then counts are exchanged between signatures, each time
the exchange that lowers the deviation from the targets most, until none does. Only then are rows
chosen, at random within each signature. The exchange works on counts, so it doesn't grow with the books:
the driver holds one number per signature, and signatures are categories.

Which targets can't be met shows in a sample that has each stratum's need as its floor: after the repair,
a stratum below its need has no book left to exchange.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.seeded import take_by_hash
from quire.plans.runtime import cut

#: Weight of a book too many or too few in a publisher or series, against one in a stratum.
SIDE_WEIGHT = 0.1


def _key(c: str):
    return F.lower(F.trim(F.col(c)))


def strata(books: DataFrame, targets: DataFrame) -> DataFrame:
    """Distinct (id, stratum): any row of an id puts it into its tier and category, without outer blanks and case."""
    rows = books.select("id", _key("publisher_tier").alias("t"), _key("series_size_category").alias("c")).where("id IS NOT NULL").distinct()
    keys = targets.select(_key("publisher_tier").alias("t"), _key("series_size_category").alias("c"), F.concat_ws("\x1f", "publisher_tier", "series_size_category").alias("stratum"))
    return rows.join(keys, ["t", "c"]).select("id", "stratum").distinct()


def _needs(targets: DataFrame, k: int) -> list[tuple[str, int, float, int]]:
    """(stratum, floor, target, need): need is the greater of the floor and the target rounded up."""
    out = []
    for r in targets.collect():
        pct, least = int(r["target_pct"] or 0), int(r["min_books"] or 0)
        out.append(("\x1f".join((r["publisher_tier"] or "", r["series_size_category"] or "")), least, pct * k / 100, max(least, -(-pct * k // 100))))
    return sorted(out)


def swap_repair(available: np.ndarray, members: np.ndarray, side: list[np.ndarray], floors: np.ndarray, targets: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Counts per signature: a random start that meets the floors, then the best exchanges until none helps.

    available: records per signature; members: signature x stratum, 0 or 1; side: for each further
    category its class per signature, aimed at the population's shares.
    """
    rng = np.random.default_rng(seed)
    n, n_strata = members.shape
    k = int(min(k, available.sum()))
    have = np.zeros(n, dtype=np.int64)

    def draw(pool: np.ndarray, m: int) -> None:
        """m more records at equal intervals, from a random start, of all the pool's records in random signature order."""
        order = rng.permutation(n)
        room = np.where(pool, available - have, 0)[order]
        ends = np.cumsum(room)
        total = int(ends[-1]) if n else 0
        m = int(min(m, total))
        if m > 0:
            start = rng.random() * total
            whole, part = np.divmod(ends, total)  # split, so that no product is larger than a float holds exactly
            upto = np.floor((part * float(m) + start) / total).astype(np.int64) + whole * m
            have[order] += np.minimum(np.diff(upto, prepend=0), room)
            short = m - int(np.minimum(np.diff(upto, prepend=0), room).sum())
            for i in order[np.argsort(have[order] - available[order], kind="stable")][:short]:  # only by rounding
                have[i] += 1

    for s in np.argsort(available @ members, kind="stable"):
        draw(members[:, s] > 0, int(floors[s] - have @ members[:, s]))
    draw(np.ones(n, dtype=bool), k - int(have.sum()))
    goals = [np.bincount(c, weights=available, minlength=c.max() + 1) * k / max(1, available.sum()) for c in side]
    floors = np.minimum(floors, available @ members)

    def step(level: np.ndarray, goal: np.ndarray, up: int) -> np.ndarray:
        """Change of the deviation when one class gains or loses one."""
        return np.abs(level + up - goal) - np.abs(level - goal)

    def deviation() -> float:
        off = np.abs(have @ members - targets).sum()
        return off + SIDE_WEIGHT * sum(np.abs(np.bincount(c, weights=have, minlength=len(g)) - g).sum() for c, g in zip(side, goals))

    best_exchange = _exchanges(members, side)
    while True:  # each step drops a record too many or lowers the deviation, so this ends
        x = have @ members
        levels = [np.bincount(c, weights=have, minlength=len(g)) for c, g in zip(side, goals)]
        ups, downs = ([SIDE_WEIGHT * step(v, g, up) for v, g in zip(levels, goals)] for up in (1, -1))
        if int(have.sum()) > k:
            can_drop = (have > 0) & ~((members > 0) & (x - 1 < floors)).any(axis=1)
            if can_drop.any():
                loss = members @ step(x, targets, -1) + sum((u[c] for c, u in zip(side, downs)), np.zeros(n))
                have[int(np.argmin(np.where(can_drop, loss, np.inf)))] -= 1
                continue
        delta, a, d = best_exchange(have < available, have > 0, step(x, targets, 1), step(x, targets, -1), x - 1 < floors, ups, downs)
        if delta >= -1e-9:
            break
        before = deviation()
        room = min(available[a] - have[a], have[d])
        if (members[a] != members[d]).any():
            over = np.where(members[d] > members[a], x - targets, np.inf).min()
            under = np.where(members[a] > members[d], targets - x, np.inf).min()
            slack = np.where(members[d] > members[a], x - floors, np.inf).min()
            m = int(max(1, min(room, over, under, slack)))
        else:  # as many as every publisher and series concerned still needs or can spare
            spare = [min(g[c[a]] - v[c[a]] if v[c[a]] < g[c[a]] else np.inf, v[c[d]] - g[c[d]] if v[c[d]] > g[c[d]] else np.inf) for c, v, g in zip(side, levels, goals) if c[a] != c[d]]
            m = int(max(1, min([room, *spare])))
        have[a] += m
        have[d] -= m
        if m > 1 and deviation() >= before:  # many at once overshot a publisher or series: one is sure to help
            have[a] -= m - 1
            have[d] += m - 1
    return have


def _exchanges(members: np.ndarray, side: list[np.ndarray]):
    """The search for the best exchange (change, signature that gains one, signature that loses one) over all pairs.

    A class both signatures share doesn't change, and leaving it out of the sum never overrates an exchange. So
    for each set of shared classes the best gain and loss per shared classes and membership pattern are enough:
    every pair is covered, and no matrix of pairs is made.
    """
    patterns, pattern = np.unique(members, axis=0, return_inverse=True)
    pattern, p = pattern.reshape(-1), len(patterns)
    inside, outside = patterns.astype(float), 1.0 - patterns
    forms = []
    for chosen in itertools.product((False, True), repeat=len(side)):
        key = np.zeros(len(members), dtype=np.int64)
        for c, shared in zip(side, chosen):
            if shared:
                key = np.unique(key * (int(c.max()) + 1) + c, return_inverse=True)[1].reshape(-1)
        group = key * p + pattern
        order = np.argsort(group, kind="stable")
        starts = np.flatnonzero(np.diff(group[order], prepend=-1))
        of_key, of_pattern = key[order[starts]], pattern[order[starts]]
        by_pattern = np.argsort(of_pattern, kind="stable")
        own = np.split(by_pattern, np.cumsum(np.bincount(of_pattern, minlength=p))[:-1])
        forms.append((chosen, order, starts, of_key, of_pattern, own, np.full(int(key.max()) + 1, np.inf)))

    def search(can_add, can_drop, up, down, at_floor, ups, downs) -> tuple[float, int, int]:
        best, found = np.inf, None
        costs = []
        for chosen, order, starts, _, of_pattern, *_ in forms:
            plus, minus = np.where(can_add, 0.0, np.inf), np.where(can_drop, 0.0, np.inf)
            for c, u, w, shared in zip(side, ups, downs, chosen):
                if not shared:
                    plus, minus = plus + u[c], minus + w[c]
            gain, loss = np.minimum.reduceat(plus[order], starts), np.minimum.reduceat(minus[order], starts)
            least = np.full((2, p), np.inf)
            np.minimum.at(least[0], of_pattern, gain)
            np.minimum.at(least[1], of_pattern, loss)
            costs.append((plus, minus, gain, loss, least))
        for low in range(0, p, 1024):
            drops = slice(low, low + 1024)
            strata_change = (inside * up) @ outside[drops].T + outside @ (inside[drops] * down).T
            strata_change[outside @ (inside[drops] * at_floor).T > 0] = np.inf  # would break a floor
            for f, (_, _, _, of_key, of_pattern, own, lost) in enumerate(forms):
                gain, loss, least = costs[f][2:]
                bound = (least[0][:, None] + strata_change).min(axis=0) + least[1][drops]
                for q in np.argsort(bound, kind="stable"):
                    if bound[q] >= min(best, 0.0) - 1e-12:
                        break
                    mine = own[low + q]
                    lost[of_key[mine]] = loss[mine]
                    total = gain + lost[of_key] + strata_change[of_pattern, q]
                    lost[of_key[mine]] = np.inf
                    i = int(np.argmin(total))
                    if total[i] < best:
                        best, found = float(total[i]), (f, i, mine[of_key[mine] == of_key[i]][0])
        if found is None:
            return np.inf, -1, -1
        f, i, j = found
        _, order, starts, *_ = forms[f]
        ends = np.append(starts[1:], len(order))
        adds, drops = order[starts[i] : ends[i]], order[starts[j] : ends[j]]
        return best, int(adds[np.argmin(costs[f][0][adds])]), int(drops[np.argmin(costs[f][1][drops])])

    return search


def _signatures(books: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, member strata joined, publisher, series): publisher and series of an id's last loaded row."""
    mine = strata(books, targets).groupBy("id").agg(F.array_join(F.sort_array(F.collect_set("stratum")), "\x1e").alias("strata"))
    last = books.where("id IS NOT NULL").groupBy("id").agg(F.max(F.struct("loaded_at", F.coalesce(_key("publisher"), F.lit("")).alias("publisher"), F.coalesce(_key("series"), F.lit("")).alias("series"))).alias("r"))
    rows = last.join(mine, "id", "left")
    return rows.select("id", F.coalesce("strata", F.lit("")).alias("strata"), F.col("r.publisher").alias("publisher"), F.col("r.series").alias("series"))


def plan_sample(books: DataFrame, targets: DataFrame, share: int = 10, seed: int = 42, need_as_floor: bool = False) -> tuple[DataFrame, list, list]:
    """Books with signatures, wanted counts per signature, and a report per stratum.

    need_as_floor makes the greater of floor and rounded-up target every stratum's floor, even if that needs a larger sample.
    """
    signed = cut(_signatures(books, targets), "signed")
    k = signed.count() // share
    needs = _needs(targets, k)
    rows = signed.withColumn("signature", F.concat_ws("\x1d", "strata", "publisher", "series"))
    counts = sorted((r["signature"], int(r["n"])) for r in rows.groupBy("signature").agg(F.count("*").alias("n")).collect())
    place = {s: i for i, (s, *_) in enumerate(needs)}
    members = np.zeros((len(counts), len(needs)), dtype=np.int64)
    sides: list[list[str]] = [[], []]
    for i, (signature, _) in enumerate(counts):
        own, publisher, series = signature.split("\x1d")
        for s in filter(None, own.split("\x1e")):
            members[i, place[s]] = 1
        sides[0].append(publisher)
        sides[1].append(series)
    available = np.asarray([n for _, n in counts], dtype=np.int64)
    side = [np.unique(np.asarray(v, dtype=object).astype(str), return_inverse=True)[1] for v in sides] if counts else []
    floors, goals = np.asarray([n[3 if need_as_floor else 1] for n in needs], dtype=np.int64), np.asarray([n[2] for n in needs])
    have = swap_repair(available, members, side, floors, goals, k, seed) if counts else np.zeros(0, dtype=np.int64)
    quotas = [(s, int(m)) for (s, _), m in zip(counts, have) if m > 0]
    capacity, reached = available @ members, have @ members
    report = [(*s.split("\x1f"), int(c), floor, goal, need, int(x), bool(x < need), bool(x < floor)) for (s, floor, goal, need), c, x in zip(needs, capacity, reached)]
    return rows, quotas, report


def draw_sample(books: DataFrame, targets: DataFrame, share: int = 10, seed: int = 42) -> DataFrame:
    """Sampled ids with strata, publisher and series; a tenth of the distinct ids by default, more only where
    the floors alone need more.

    Null ids are no books; rows of one id are one book. Strata unknown to the targets have no target.
    An empty table gives an empty sample.
    """
    rows, quotas, _ = plan_sample(books, targets, share, seed)
    spark = books.sparkSession
    want = spark.createDataFrame(quotas, "signature string, quota bigint")
    got = take_by_hash(rows.withColumn("one", F.lit(1).cast("long")), "signature", "id", "one", want, seed)
    return got.select("id", F.split("strata", "\x1e").alias("strata"), "publisher", "series")


_REPORT = "publisher_tier string, series_size_category string, n_books bigint, min_books bigint, target_books double, need bigint, n_sampled bigint, below_need boolean, below_floor boolean"


def strata_report(books: DataFrame, targets: DataFrame, share: int = 10, seed: int = 42, need_as_floor: bool = False) -> DataFrame:
    """Per stratum: books held, floor, target, need, sampled, below_need (sampled < need), below_floor (sampled < floor)."""
    _, _, report = plan_sample(books, targets, share, seed, need_as_floor)
    return books.sparkSession.createDataFrame(report, _REPORT)


def find_short_strata(books: DataFrame, targets: DataFrame, share: int = 10, seed: int = 42) -> DataFrame:
    """Strata that stay below the greater of floor and rounded-up target in the repaired sample that has these needs
    as floors: it holds all their books, and they are too few."""
    return strata_report(books, targets, share, seed, need_as_floor=True).where("below_need").select("publisher_tier", "series_size_category")
