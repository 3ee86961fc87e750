"""Stratified book samples with temporal coverage, and their audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.plans.runtime import cut, numbered, numbered_within

#: Shares of the plan.
TIER_SHARES = {"A": 0.60, "B": 0.25, "C": 0.15}
SERIES_SHARE, STANDALONE_SHARE = 0.40, 0.60
SIZE_SHARES = {"Large": 0.50, "Medium": 0.35, "Small": 0.15}


def first_rows(books: DataFrame) -> DataFrame:
    """One row per id: the one loaded first, ties by title. Null ids are dropped."""
    w = Window.partitionBy("id").orderBy("loaded_at", "title", "publisher", "series")
    return books.where("id IS NOT NULL").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def publisher_tiers(books: DataFrame, low: int, high: int) -> DataFrame:
    """Publisher, its books, and tier: A above high, B from low to high, C below, Unknown for null."""
    by = books.groupBy("publisher").agg(F.count("*").alias("n_books"))
    n = F.col("n_books")
    return by.withColumn("tier", F.when(F.col("publisher").isNull(), "Unknown").when(n > high, "A").when(n >= low, "B").otherwise("C"))


def series_sizes(books: DataFrame, low: int, high: int) -> DataFrame:
    """Series, its books, and size: Large above high, Medium from low to high, Small below; '?' is no series."""
    by = books.where("series IS NOT NULL AND series <> '?'").groupBy("series").agg(F.count("*").alias("n_books"))
    n = F.col("n_books")
    return by.withColumn("size_category", F.when(n > high, "Large").when(n >= low, "Medium").otherwise("Small"))


def classify(books: DataFrame, tier: tuple[int, int], size: tuple[int, int]) -> DataFrame:
    """Books with tier, book_type and size_category. A null series is a series of unknown size."""
    tiers = publisher_tiers(books, *tier).where("publisher IS NOT NULL").select("publisher", "tier")
    sizes = series_sizes(books, *size).select("series", "size_category")
    rows = books.join(tiers, "publisher", "left").join(sizes, "series", "left")
    kind = F.when(F.coalesce(F.col("series") != "?", F.lit(True)), "Series").otherwise("Standalone")
    category = F.when(F.col("series") == "?", "N/A").otherwise(F.coalesce("size_category", F.lit("Unknown")))
    return rows.select("id", "title", "publisher", "series", "date_text", F.coalesce("tier", F.lit("Unknown")).alias("tier"), kind.alias("book_type"), category.alias("size_category"))


def temporal_positions(books: DataFrame) -> DataFrame:
    """(series, id, temporal_position, pick) of a series' picks: first, middle, last, and quarters beyond six books.

    A series is ordered by numeric date, nulls last, or by id if it has none; ties by id.
    """
    own = Window.partitionBy("series")
    date = F.expr("try_cast(date_text AS DOUBLE)")
    rows = books.where("series IS NOT NULL AND series <> '?'").select("series", "id", date.alias("d"))
    rows = rows.withColumn("n", F.count("*").over(own)).withColumn("pos", F.row_number().over(own.orderBy(F.asc_nulls_last("d"), "id")) - 1)
    n, pos = F.col("n"), F.col("pos")
    pick = (
        F.when((n == 1), F.struct(F.lit("only_book").alias("temporal_position"), F.lit(1).alias("pick")))
        .when(pos == 0, F.struct(F.lit("first").alias("temporal_position"), F.lit(1).alias("pick")))
        .when((n >= 3) & (pos == F.floor(n / 2)) & (n > 3), F.struct(F.lit("middle").alias("temporal_position"), F.lit(2).alias("pick")))
        .when((n == 3) & (pos == 1), F.struct(F.lit("middle").alias("temporal_position"), F.lit(2).alias("pick")))
        .when(pos == n - 1, F.struct(F.lit("last").alias("temporal_position"), F.when(n == 2, 2).otherwise(3).alias("pick")))
        .when((n > 6) & (pos == F.floor(n / 4)), F.struct(F.lit("quarter_1").alias("temporal_position"), F.lit(4).alias("pick")))
        .when((n > 6) & (pos == F.floor(n * 3 / 4)), F.struct(F.lit("quarter_3").alias("temporal_position"), F.lit(5).alias("pick")))
    )
    return rows.withColumn("p", pick).where("p IS NOT NULL").select("series", "id", "p.temporal_position", F.col("p.pick").cast("long").alias("pick"))


def hash_order(key: Column, seed: int) -> Column:
    """A seeded order that both engines can compute."""
    return F.md5(F.concat(key, F.lit(f":{seed}")))


def quotas(n: int) -> list[tuple[str, str, int]]:
    """(tier, size or 'N/A', books); every product is cut to a whole number."""
    out = []
    for tier, share in TIER_SHARES.items():
        size = int(n * share)
        series = int(size * SERIES_SHARE)
        out += [(tier, name, int(series * s)) for name, s in SIZE_SHARES.items()]
        out.append((tier, "N/A", int(size * STANDALONE_SHARE)))
    return out


def stratified_sample(classified: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """(id, tier, size_category, sampling_strategy, temporal_position) of the plan for n books.

    Large and Medium series give their temporal picks, an equal number each, in order of the series' name, until
    the tier's quota is met; picks are those of the whole series. Small series and standalone books are filled in
    seeded hash order. An id picked twice is kept in its first tier. No task gives away more rows of a cell than the
    largest quota.
    """
    spark = classified.sparkSession
    plan = F.broadcast(spark.createDataFrame(quotas(n), "tier string, size_category string, quota int"))  # twelve rows
    picks = temporal_positions(classified)
    in_tier = classified.where(F.col("book_type") == "Series").select("tier", "size_category", "series").distinct().where(F.col("size_category").isin("Large", "Medium"))
    in_tier = in_tier.join(plan, ["tier", "size_category"])
    n_series = in_tier.groupBy("tier", "size_category").agg(F.count("*").alias("n_series"))
    per = F.greatest(F.lit(1), F.floor(F.col("quota") / F.col("n_series")))
    temporal = in_tier.join(n_series, ["tier", "size_category"]).join(picks, "series").where(F.col("pick") <= per)
    w = Window.partitionBy("tier", "size_category").orderBy("series", "pick")
    temporal = temporal.withColumn("r", F.row_number().over(w)).where("r <= quota")
    temporal = temporal.select("id", "tier", "size_category", F.concat(F.lit("Temporal ("), "size_category", F.lit(" Series)")).alias("sampling_strategy"), "temporal_position")
    pool = classified.where(((F.col("book_type") == "Series") & (F.col("size_category") == "Small")) | (F.col("book_type") == "Standalone"))
    pool = pool.select("id", "tier", F.when(F.col("book_type") == "Standalone", "N/A").otherwise("Small").alias("size_category")).join(plan, ["tier", "size_category"])
    w = Window.partitionBy("tier", "size_category").orderBy(hash_order(F.col("id"), seed), "id")
    most = max(m for *_, m in quotas(n))  # a constant, so that each task ranks and gives away that many rows a cell at most
    fill = pool.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).where("r <= quota")
    name = F.when(F.col("size_category") == "N/A", "Random (Standalone)").otherwise("Random (Small Series)")
    fill = fill.select("id", "tier", "size_category", name.alias("sampling_strategy"), F.lit("N/A").alias("temporal_position"))
    both = temporal.unionByName(fill)
    first = F.min(F.struct("tier", F.array_position(F.array(*map(F.lit, ("Large", "Medium", "Small", "N/A"))), F.col("size_category")).alias("o"), "size_category", "sampling_strategy", "temporal_position")).alias("f")
    return both.groupBy("id").agg(first).select("id", "f.tier", "f.size_category", "f.sampling_strategy", "f.temporal_position")


def audit(sample: DataFrame, collected: DataFrame, total: int) -> DataFrame:
    """Per tier: planned, collected, and the share of the corpus collected, in percent."""
    got = collected.select("id").distinct().withColumn("got", F.lit(1))
    by = sample.join(got, "id", "left").groupBy("tier").agg(F.count("*").alias("planned"), F.count("got").alias("collected"))
    return by.withColumn("corpus_percent", F.round(F.col("collected") * 100.0 / max(total, 1), 4))


def sorted_sample(sample: DataFrame, classified: DataFrame) -> DataFrame:
    """(place, id, tier, book_type, series) of the sample in order of tier, type, series and id; nulls first."""
    rows = sample.select("id", "tier").join(classified.select("id", "book_type", "series"), "id")
    return numbered(rows, ["tier", "book_type", "series", "id"], "place").select("place", "id", "tier", "book_type", "series")


def series_statistics(sample: DataFrame, books: DataFrame) -> DataFrame:
    """One row: series in the sample, its books from series, and their mean number per series."""
    series = books.where("series IS NOT NULL AND series <> '?'").select("id", "series").dropDuplicates(["id", "series"])
    by = sample.select("id").join(series, "id").agg(F.count_distinct("series").alias("n_series"), F.count_distinct("id").alias("n_books"))
    return by.withColumn("books_per_series", F.round(F.col("n_books") / F.greatest("n_series", F.lit(1)), 2))


def sample_statistics(sample: DataFrame) -> DataFrame:
    """Value counts of the sample's columns as (aspect, value, n)."""
    parts = [sample.groupBy(F.lit(c).alias("aspect"), F.col(c).alias("value")).agg(F.count("*").alias("n")) for c in ("tier", "size_category", "sampling_strategy", "temporal_position")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def random_pick(ids: DataFrame, known: DataFrame, n: int, seed: int, key: str = "id") -> DataFrame:
    """n ids not among the known, the first in seeded hash order; a top-n, no full sort."""
    return ids.select(key).distinct().join(known.select(key), key, "left_anti").orderBy(hash_order(F.col(key), seed), key).limit(n)


def prioritised(units: DataFrame, need: int, seed: int, key: str = "id", kind: str = "inferred_type") -> DataFrame:
    """`need` units: those that are no chapter or novel first, then chapters, each in seeded hash order."""
    chapter = F.coalesce(F.col(kind).isin("chapter", "novel"), F.lit(False)).cast("int")
    rows = units.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(chapter).alias("priority"))
    return rows.orderBy("priority", hash_order(F.col(key), seed), key).limit(need)


def selection_batches(units: DataFrame, need: int, seed: int, size: int = 20, first: int = 1) -> DataFrame:
    """The prioritised selection shuffled by a seed and cut into files of `size` units: (id, batch, file name)."""
    picked = prioritised(units, need, seed).select("id").withColumn("_o", hash_order(F.col("id"), seed + 1))
    rows = numbered(picked, ["_o", "id"], "_n")
    batch = (F.floor((F.col("_n") - 1) / size) + first).cast("long")
    return rows.select("id", batch.alias("batch")).withColumn("file_name", F.concat(F.lit("gold_chunks_part_"), F.format_string("%02d", "batch"), F.lit(".json")))


def batch_names(units: DataFrame, file: str, book: str, order: list[str], size: int = 20) -> DataFrame:
    """File names of batches per (file, book): _book<b>, and _part<p> only where a book has more than `size` units.

    The order must be unique within a book; a book of any size is spread over tasks.
    """
    rows = cut(numbered_within(units, [file, book], order, "_place"), "placed")
    large = rows.where(F.col("_place") == size + 1).select(F.col(file).alias("_f"), F.col(book).alias("_b"))  # one row a book
    rows = rows.join(large, F.col(file).eqNullSafe(F.col("_f")) & F.col(book).eqNullSafe(F.col("_b")), "left")
    part = (F.floor((F.col("_place") - 1) / size) + 1).cast("long")
    name = F.concat(F.col(file), F.lit("_book"), F.col(book).cast("string"), F.when(F.col("_f").isNotNull() | F.col("_b").isNotNull(), F.concat(F.lit("_part"), part.cast("string"))).otherwise(""))
    return rows.withColumn("part", part).withColumn("batch_name", name).drop("_place", "_f", "_b")
