"""Seeded selection of rows up to a quota per cell, without sorting a whole cell in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.plans.runtime import cut, join_checked

#: A cell's rows are spread over so many hash buckets; only the bucket in which the quota ends is ordered.
BUCKETS = 1024


def take_by_hash(rows: DataFrame, cell: str, key: str, weight: str, quotas: DataFrame, seed: int) -> DataFrame:
    """The rows of each cell taken in seeded hash order while their summed weight stays within the quota.

    quotas has the cell and `quota`; a cell without one gives no rows. Whole buckets are taken first,
    then rows of the bucket in which the quota ends, as long as the sum stays within it.
    """
    rows = rows.withColumn("_h", F.xxhash64(F.col(key).cast("string"), F.lit(seed)))
    rows = rows.withColumn("_b", F.pmod(F.shiftright("_h", 13), F.lit(BUCKETS)).cast("int"))
    sums = rows.groupBy(cell, "_b").agg(F.sum(weight).alias("_w"))
    order = Window.partitionBy(cell).orderBy("_b")  # at most BUCKETS rows
    upto = F.sum("_w").over(order)
    state = sums.join(quotas.select(cell, "quota"), cell).withColumn("_to", upto)
    state = cut(state.select(cell, "_b", F.least(F.col("_w"), F.col("quota") - (F.col("_to") - F.col("_w"))).alias("_room"), (F.col("_to") <= F.col("quota")).alias("_all")).where("_all OR _room > 0"), "state")
    got = join_checked(rows, state, [cell, "_b"], "inner")
    whole = got.where("_all")
    inner = Window.partitionBy(cell, "_b").orderBy("_h", key)
    part = got.where("NOT _all").withColumn("_run", F.sum(weight).over(inner.rowsBetween(Window.unboundedPreceding, 0))).where("_run <= _room").drop("_run")
    return whole.unionByName(part).drop("_h", "_b", "_room", "_all")
