"""Books cut into work units: tree ids, strategies, separator splits, and their reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.plans.runtime import cut, numbered_within

#: The strategies in report order.
STRATEGIES = ("explicit_chapter", "implicit_chapter_stars", "implicit_chapter_jpg", "novel_no_separator", "non-chapter")
#: Separators; Unicode white space counts. The star pattern is flat, so long star lines can't exhaust the stack.
STAR = r"(?U)<p[^>]*>[\s*]*\*[\s*]*</p>"
IMAGE = r"(?U)<p[^>]*>(?:<p[^>]*>)?\s*<graphic[^>]*url=\"[^\"]+\.jpg\"[^>]*/>\s*(?:\s*</p>){1,2}"


def is_chapter(kind: Column) -> Column:
    return F.coalesce(F.contains(F.lower(kind), F.lit("chapter")), F.lit(False))


def has_text(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))


def strategy(text: Column, kind: Column) -> Column:
    """Chapter types whole; novels by stars, else by images, else whole; all else is no chapter."""
    novel = kind == "novel"
    return (
        F.when(is_chapter(kind), STRATEGIES[0]).when(novel & text.rlike(STAR), STRATEGIES[1])
        .when(novel & text.rlike(IMAGE), STRATEGIES[2]).when(novel, STRATEGIES[3]).otherwise(STRATEGIES[4])
    )


def split_parts(text: Column, pattern: str) -> Column:
    """Parts between separators without blank ones; numbered after blanks are dropped."""
    return F.filter(F.split(text, pattern, -1), lambda p: p.rlike(r"(?U)\S"))


def work_units(nodes: DataFrame, id_col: str, file_col: str, text_col: str, kind_col: str) -> DataFrame:
    """id, source_file, html, inferred_type, strategy, status, part_no of every work unit; narrow, no shuffle.

    Nodes without non-blank text give none. Split parts get the id suffix _partNN, from 1 for each node.
    """
    rows = nodes.where(has_text(F.col(text_col))).withColumn("strategy", strategy(F.col(text_col), F.col(kind_col)))
    parts = F.when(F.col("strategy") == STRATEGIES[1], split_parts(F.col(text_col), STAR)).when(F.col("strategy") == STRATEGIES[2], split_parts(F.col(text_col), IMAGE)).otherwise(F.array(F.col(text_col)))
    rows = rows.select(F.col(id_col).alias("base"), F.col(file_col).alias("source_file"), F.col(kind_col).alias("inferred_type"), "strategy", F.posexplode(parts).alias("pos", "html"))
    part = F.col("strategy").isin(STRATEGIES[1], STRATEGIES[2])
    unit = F.when(part, F.concat("base", F.format_string("_part%02d", F.col("pos") + 1))).otherwise(F.col("base"))
    status = F.when(F.col("strategy") == STRATEGIES[3], "uncertain").otherwise("success")
    return rows.select(unit.alias("id"), "source_file", "html", "inferred_type", "strategy", status.alias("status"), F.when(part, F.col("pos") + 1).otherwise(0).cast("long").alias("part_no"))


def count_parts(text: Column, kind: Column) -> Column:
    """Pieces under the counting rule: any type without lower-case 'chapter' in it is split by stars, else by images."""
    stars, images = split_parts(text, STAR), split_parts(text, IMAGE)
    whole = F.coalesce(F.contains(kind, F.lit("chapter")), F.lit(True))
    return F.when(whole, 1).when(text.rlike(STAR), F.size(stars)).when(text.rlike(IMAGE), F.size(images)).otherwise(1).cast("long")


def literal_split(nodes: DataFrame, id_col: str, text_col: str, mark: str = r"\*\*\*") -> DataFrame:
    """Split at a literal ***; numbers are those before blank parts are dropped, so they may have gaps."""
    rows = nodes.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text_col), mark, -1)).alias("pos", "part"))
    return rows.where(has_text(F.col("part"))).select("id", F.col("pos").cast("long").alias("part_no"), F.length("part").cast("long").alias("n_chars"))


def strategy_report(units: DataFrame, file_col: str = "source_file", names: Sequence[str] = STRATEGIES) -> DataFrame:
    """Units per file and strategy, absent ones as 0, with a total."""
    counts = [F.count_if(F.col("strategy") == s).alias(s.replace("-", "_")) for s in names]
    return units.groupBy(file_col).agg(*counts, F.count("*").alias("total"))


def strategy_aggregate(units: DataFrame, names: Sequence[str] = STRATEGIES) -> DataFrame:
    """Units per strategy over all files, absent ones as 0, and the row 'total'."""
    one = units.agg(*(F.count_if(F.col("strategy") == s).alias(f"c{i}") for i, s in enumerate(names)), F.count("*").alias("t"))
    entries = [F.struct(F.lit(s).alias("strategy"), F.col(f"c{i}").alias("chunk_count")) for i, s in enumerate(names)]
    entries.append(F.struct(F.lit("total").alias("strategy"), F.col("t").alias("chunk_count")))
    return one.select(F.inline(F.array(*entries)))


def file_summary(units: DataFrame, file_col: str = "source_file") -> DataFrame:
    """Units per file and the sorted, comma-joined strategies."""
    return units.groupBy(file_col).agg(F.count("*").alias("n_units"), F.array_join(F.array_sort(F.collect_set("strategy")), ",").alias("strategies"))


def prefix_of(id_col: Column) -> Column:
    return F.regexp_replace(id_col, "_[^_]*$", "")


def index_ranges(units: DataFrame, file_col: str, order: Sequence[str]) -> DataFrame:
    """Runs of consecutive units with the same prefix, by file: first and last index of each run, from 0.

    The order must be unique within a file. Units are numbered, and each is compared with the one before it by its
    number, so a file of any size is spread over tasks.
    """
    rows = numbered_within(units.withColumn("prefix", prefix_of(F.col("id"))).select(file_col, *order, "prefix"), [file_col], order, "idx")
    rows = cut(rows.select(F.col(file_col).alias("file"), F.col("idx") - 1, "prefix").toDF("file", "idx", "prefix"), "indexed")
    before = rows.select(F.col("file").alias("f"), (F.col("idx") + 1).alias("i"), F.col("prefix").alias("p"))
    starts = rows.join(before, F.col("file").eqNullSafe(F.col("f")) & (F.col("idx") == F.col("i")), "left").where(F.col("i").isNull() | ~F.col("prefix").eqNullSafe(F.col("p")))
    runs = cut(numbered_within(starts.select("file", "idx", "prefix"), ["file"], ["idx"], "run"), "runs")
    last = rows.groupBy(F.col("file").alias("f")).agg(F.max("idx").alias("last"))
    following = runs.select(F.col("file").alias("g"), (F.col("run") - 1).alias("r"), (F.col("idx") - 1).alias("next"))
    out = runs.join(following, F.col("file").eqNullSafe(F.col("g")) & (F.col("run") == F.col("r")), "left").join(last, F.col("file").eqNullSafe(F.col("f")))
    return out.select(F.col("file").alias(file_col), "run", "prefix", F.col("idx").cast("long").alias("start_idx"), F.coalesce("next", "last").cast("long").alias("end_idx"))


def batches(rows: DataFrame, within: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    """Batch numbers from 1, `size` rows each, within each group; the order must be unique within a group."""
    return numbered_within(rows, within, order, "_place").withColumn("batch", (F.floor((F.col("_place") - 1) / size) + 1).cast("long")).drop("_place")


def one_per_category(units: DataFrame, category: str, seed: int, key: str = "id") -> DataFrame:
    """One unit per category, the first in seeded hash order; an aggregate, so a category isn't sorted."""
    pick = F.min_by(key, F.struct(F.md5(F.concat(F.col(key), F.lit(f":{seed}"))), key))
    return units.groupBy(category).agg(pick.alias(key))


def preview(text: Column, n: int = 200) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def inspection(units: DataFrame) -> DataFrame:
    """Unit, type shortened to 17 characters and '...' beyond 20, strategy, and length of the markup."""
    kind = F.coalesce("inferred_type", F.lit("None"))
    short = F.when(F.length(kind) > 20, F.concat(F.substring(kind, 1, 17), F.lit("..."))).otherwise(kind)
    return units.select("id", short.alias("type_short"), "strategy", F.length("html").cast("long").alias("html_length"))
