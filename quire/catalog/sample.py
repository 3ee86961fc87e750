"""Strata, samples with temporal coverage, and audits over the book metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.catalog.registry import query
from quire.operators import sampling
from quire.plans.runtime import cut
from quire.plans.runtime import read_table as _t
from quire.sources import readers

TIER, SIZE, N = (50, 200), (10, 40), 100
_FIRST = "WITH b AS (SELECT * FROM sample_data WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at NULLS FIRST, title NULLS FIRST, publisher NULLS FIRST, series NULLS FIRST) = 1)"
_TIERS = f", tiers AS (SELECT publisher, count(*) AS n_books, CASE WHEN publisher IS NULL THEN 'Unknown' WHEN count(*) > {TIER[1]} THEN 'A' WHEN count(*) >= {TIER[0]} THEN 'B' ELSE 'C' END AS tier FROM b GROUP BY publisher)"
_SIZES = f", sizes AS (SELECT series, count(*) AS n_books, CASE WHEN count(*) > {SIZE[1]} THEN 'Large' WHEN count(*) >= {SIZE[0]} THEN 'Medium' ELSE 'Small' END AS size_category FROM b WHERE series <> '?' GROUP BY series)"
_CLASS = _FIRST + _TIERS + _SIZES + ", cl AS (SELECT b.id, title, b.publisher, b.series, date_text, coalesce(tier, 'Unknown') AS tier, CASE WHEN b.series = '?' THEN 'Standalone' ELSE 'Series' END AS book_type, CASE WHEN b.series = '?' THEN 'N/A' ELSE coalesce(size_category, 'Unknown') END AS size_category FROM b LEFT JOIN tiers ON tiers.publisher = b.publisher LEFT JOIN sizes ON sizes.series = b.series)"
_PICKS = """, o AS (SELECT series, id, count(*) OVER (PARTITION BY series) AS n, row_number() OVER (PARTITION BY series ORDER BY try_cast(date_text AS DOUBLE) NULLS LAST, id) - 1 AS pos FROM b WHERE series <> '?'),
pk AS (SELECT series, id, CASE WHEN n = 1 THEN 'only_book' WHEN pos = 0 THEN 'first' WHEN n > 3 AND pos = n // 2 THEN 'middle' WHEN n = 3 AND pos = 1 THEN 'middle' WHEN pos = n - 1 THEN 'last' WHEN n > 6 AND pos = n // 4 THEN 'quarter_1' WHEN n > 6 AND pos = n * 3 // 4 THEN 'quarter_3' END AS temporal_position,
 CASE WHEN pos = 0 THEN 1 WHEN n > 3 AND pos = n // 2 THEN 2 WHEN n = 3 AND pos = 1 THEN 2 WHEN pos = n - 1 THEN CASE WHEN n = 2 THEN 2 ELSE 3 END WHEN n > 6 AND pos = n // 4 THEN 4 ELSE 5 END AS pick FROM o),
picks AS (SELECT * FROM pk WHERE temporal_position IS NOT NULL)"""
_QUOTA = ", q(tier, size_category, quota) AS (VALUES " + ", ".join(f"('{t}', '{s}', {n})" for t, s, n in sampling.quotas(N)) + ")"
_SAMPLE = _CLASS + _PICKS + _QUOTA + """, ser AS (SELECT DISTINCT tier, size_category, series FROM cl WHERE book_type = 'Series' AND size_category IN ('Large', 'Medium')),
per AS (SELECT s.tier, s.size_category, any_value(quota) AS quota, greatest(1, any_value(quota) // count(*)) AS per FROM ser s JOIN q USING (tier, size_category) GROUP BY ALL),
temporal AS (SELECT p.id, s.tier, s.size_category, 'Temporal (' || s.size_category || ' Series)' AS sampling_strategy, temporal_position FROM ser s JOIN per USING (tier, size_category) JOIN picks p USING (series) WHERE pick <= per QUALIFY row_number() OVER (PARTITION BY s.tier, s.size_category ORDER BY s.series, pick) <= any_value(quota) OVER (PARTITION BY s.tier, s.size_category)),
pool AS (SELECT id, tier, CASE WHEN book_type = 'Standalone' THEN 'N/A' ELSE 'Small' END AS size_category FROM cl WHERE book_type = 'Standalone' OR size_category = 'Small'),
fill AS (SELECT id, tier, size_category, CASE WHEN size_category = 'N/A' THEN 'Random (Standalone)' ELSE 'Random (Small Series)' END AS sampling_strategy, 'N/A' AS temporal_position FROM pool JOIN q USING (tier, size_category) QUALIFY row_number() OVER (PARTITION BY tier, size_category ORDER BY md5(id || ':42'), id) <= quota),
sam AS (SELECT * FROM (SELECT * FROM temporal UNION ALL SELECT * FROM fill) QUALIFY row_number() OVER (PARTITION BY id ORDER BY tier, list_position(['Large', 'Medium', 'Small', 'N/A'], size_category)) = 1)"""


def _books(spark: SparkSession, d: str) -> DataFrame:
    return sampling.first_rows(_t(spark, d, "sample_data"))


def _classified(spark: SparkSession, d: str) -> DataFrame:
    return sampling.classify(_books(spark, d), TIER, SIZE)


def _sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.stratified_sample(cut(_classified(spark, d), "classified"), N)


@query(_FIRST + _TIERS + "SELECT publisher, n_books, tier FROM tiers")
def publisher_tiers(spark, d):
    return sampling.publisher_tiers(_books(spark, d), *TIER)


@query(_FIRST + _SIZES + "SELECT series, n_books, size_category FROM sizes")
def series_size(spark, d):
    return sampling.series_sizes(_books(spark, d), *SIZE)


@query(_CLASS + "SELECT id, title, publisher, series, date_text, tier, book_type, size_category FROM cl")
def classified_books(spark, d):
    return _classified(spark, d)


@query(_FIRST + _PICKS + "SELECT series, id, temporal_position, pick::BIGINT AS pick FROM picks")
def temporal_positions(spark, d):
    return sampling.temporal_positions(_books(spark, d))


@query(_SAMPLE + "SELECT id, tier, size_category, sampling_strategy, temporal_position FROM sam")
def stratified_sample(spark, d):
    return _sample(spark, d)


@query(_SAMPLE + ", g AS (SELECT DISTINCT split_part(source_file, '_', 1) AS id FROM chunks WHERE source_file IS NOT NULL), n AS (SELECT count(*) AS total FROM b) SELECT tier, count(*) AS planned, count(g.id) AS collected, round(count(g.id) * 100.0 / any_value(total), 4) AS corpus_percent FROM sam LEFT JOIN g USING (id), n GROUP BY tier")
def sample_audit(spark, d):
    collected = readers.collected_ids(_t(spark, d, "chunks").where("source_file IS NOT NULL"), "source_file")
    return sampling.audit(_sample(spark, d), collected, _books(spark, d).count())


@query(_SAMPLE + " ".join(("SELECT 'tier' AS aspect, tier AS value, count(*) AS n FROM sam GROUP BY ALL", *(f"UNION ALL SELECT '{c}', {c}, count(*) FROM sam GROUP BY ALL" for c in ("size_category", "sampling_strategy", "temporal_position")))))
def sample_statistics(spark, d):
    return sampling.sample_statistics(cut(_sample(spark, d), "sample"))


@query(_SAMPLE + "SELECT row_number() OVER (ORDER BY sam.tier NULLS FIRST, book_type NULLS FIRST, series NULLS FIRST, id) AS place, id, sam.tier, book_type, series FROM sam JOIN (SELECT id, book_type, series FROM cl) USING (id)")
def sorted_sample(spark, d):
    return sampling.sorted_sample(_sample(spark, d), _classified(spark, d))


@query(_SAMPLE + """, in_series AS (SELECT DISTINCT id, series FROM sample_data WHERE series IS NOT NULL AND series <> '?')
SELECT count(DISTINCT series) AS n_series, count(DISTINCT id) AS n_books, round(count(DISTINCT id) / greatest(count(DISTINCT series), 1), 2) AS books_per_series FROM sam JOIN in_series USING (id)""")
def sample_series(spark, d):
    return sampling.series_statistics(cut(_sample(spark, d), "sample"), _t(spark, d, "sample_data"))


@query("SELECT id FROM (SELECT DISTINCT id FROM sample_data WHERE id IS NOT NULL) WHERE id NOT IN (SELECT split_part(source_file, '_', 1) FROM chunks WHERE source_file IS NOT NULL) ORDER BY md5(id || ':42'), id LIMIT 50")
def random_new_books(spark, d):
    known = readers.collected_ids(_t(spark, d, "chunks").where("source_file IS NOT NULL"), "source_file")
    return sampling.random_pick(_t(spark, d, "sample_data").where("id IS NOT NULL"), known, 50, 42)


@query("SELECT src, printf('%06d_', row_number() OVER (ORDER BY src)) || replace(src, ' ', '_') AS dst FROM (SELECT DISTINCT title AS src FROM sample_data WHERE title IS NOT NULL)")
def sequential_ids(spark, d):
    return readers.epub_plan(_t(spark, d, "sample_data").where("title IS NOT NULL"), "title")


@query("SELECT id, try_cast(date_text AS DOUBLE) AS date_number, series = '?' AS standalone FROM sample_data")
def numeric_dates(spark, d):
    return _t(spark, d, "sample_data").select("id", F.expr("try_cast(date_text AS DOUBLE)").alias("date_number"), (F.col("series") == "?").alias("standalone"))
