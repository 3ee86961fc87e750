"""Chunking, work-unit reports and token statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.catalog.registry import query
from quire.functions import names
from quire.operators import chunking, sampling, tei, tei_run, textstats
from quire.plans.runtime import read_table as _t

_WS = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0B}]"
_NB = r"[^\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0B}]"
_STAR = rf"<p[^>]*>(?:{_WS}|\*)*\*(?:{_WS}|\*)*</p>"
_IMAGE = rf"<p[^>]*>(?:<p[^>]*>)?{_WS}*<graphic[^>]*url=\"[^\"]+\.jpg\"[^>]*/>{_WS}*(?:{_WS}*</p>){{1,2}}"
UNITS_SQL = f"""WITH k AS (SELECT *, CASE WHEN contains(lower(inferred_type), 'chapter') THEN 'explicit_chapter'
    WHEN inferred_type = 'novel' AND regexp_matches(text, '{_STAR}') THEN 'implicit_chapter_stars'
    WHEN inferred_type = 'novel' AND regexp_matches(text, '{_IMAGE}') THEN 'implicit_chapter_jpg'
    WHEN inferred_type = 'novel' THEN 'novel_no_separator' ELSE 'non-chapter' END AS strat FROM chunks WHERE regexp_matches(text, '{_NB}')),
parts AS (SELECT id AS base, source_file, inferred_type, strat AS strategy, CASE strat WHEN 'implicit_chapter_stars' THEN list_filter(string_split_regex(text, '{_STAR}'), lambda x: regexp_matches(x, '{_NB}'))
    WHEN 'implicit_chapter_jpg' THEN list_filter(string_split_regex(text, '{_IMAGE}'), lambda x: regexp_matches(x, '{_NB}')) ELSE [text] END AS a FROM k),
u AS (SELECT base, source_file, inferred_type, strategy, unnest(a) AS html, generate_subscripts(a, 1) AS p FROM parts),
units AS (SELECT CASE WHEN strategy IN ('implicit_chapter_stars', 'implicit_chapter_jpg') THEN base || printf('_part%02d', p) ELSE base END AS id, source_file, html, inferred_type, strategy,
    CASE WHEN strategy = 'novel_no_separator' THEN 'uncertain' ELSE 'success' END AS status, CASE WHEN strategy IN ('implicit_chapter_stars', 'implicit_chapter_jpg') THEN p ELSE 0 END AS part_no FROM u)
"""
STRATEGY_VALUES = "('explicit_chapter'), ('implicit_chapter_stars'), ('implicit_chapter_jpg'), ('novel_no_separator'), ('non-chapter')"


def _units(spark: SparkSession, d: str) -> DataFrame:
    return chunking.work_units(_t(spark, d, "chunks"), "id", "source_file", "text", "inferred_type")


@query(UNITS_SQL + "SELECT id, source_file, inferred_type, strategy, status, part_no::BIGINT AS part_no, md5(html) AS html_md5 FROM units")
def work_units(spark, d):
    return _units(spark, d).select("id", "source_file", "inferred_type", "strategy", "status", "part_no", F.md5("html").alias("html_md5"))


@query(UNITS_SQL + "SELECT id, md5(html) AS html_md5 FROM units WHERE strategy = 'implicit_chapter_stars'")
def star_split(spark, d):
    return _units(spark, d).where("strategy = 'implicit_chapter_stars'").select("id", F.md5("html").alias("html_md5"))


@query(UNITS_SQL + "SELECT id, md5(html) AS html_md5 FROM units WHERE strategy = 'implicit_chapter_jpg'")
def image_split(spark, d):
    return _units(spark, d).where("strategy = 'implicit_chapter_jpg'").select("id", F.md5("html").alias("html_md5"))


@query(f"SELECT id, (p - 1)::BIGINT AS part_no, length(part) AS n_chars FROM (SELECT id, unnest(string_split(text, '***')) AS part, generate_subscripts(string_split(text, '***'), 1) AS p FROM chunks WHERE inferred_type = 'novel' AND text IS NOT NULL) WHERE regexp_matches(part, '{_NB}')")
def literal_star_split(spark, d):
    return chunking.literal_split(_t(spark, d, "chunks").where("inferred_type = 'novel'"), "id", "text")


@query(f"SELECT sum(CASE WHEN inferred_type IS NULL OR contains(inferred_type, 'chapter') THEN 1 WHEN regexp_matches(text, '{_STAR}') THEN len(list_filter(string_split_regex(text, '{_STAR}'), lambda x: regexp_matches(x, '{_NB}'))) WHEN regexp_matches(text, '{_IMAGE}') THEN len(list_filter(string_split_regex(text, '{_IMAGE}'), lambda x: regexp_matches(x, '{_NB}'))) ELSE 1 END)::BIGINT AS n_units, source_file FROM chunks WHERE text <> '' GROUP BY source_file")
def count_units(spark, d):
    rows = _t(spark, d, "chunks").where("text <> ''")
    return rows.groupBy("source_file").agg(F.sum(chunking.count_parts(F.col("text"), F.col("inferred_type"))).alias("n_units"))


@query(UNITS_SQL + "SELECT source_file, " + ", ".join(f"count(*) FILTER (strategy = '{s}') AS {s.replace('-', '_')}" for s in chunking.STRATEGIES) + ", count(*) AS total FROM units GROUP BY source_file")
def strategy_report(spark, d):
    return chunking.strategy_report(_units(spark, d))


@query(UNITS_SQL + f"SELECT s AS strategy, count(units.id) AS chunk_count FROM (VALUES {STRATEGY_VALUES}) v(s) LEFT JOIN units ON strategy = s GROUP BY s UNION ALL SELECT 'total', count(*) FROM units")
def strategy_aggregate(spark, d):
    return chunking.strategy_aggregate(_units(spark, d))


@query(UNITS_SQL + "SELECT source_file, count(*) AS n_units, string_agg(DISTINCT strategy, ',' ORDER BY strategy) AS strategies FROM units GROUP BY source_file")
def file_summary(spark, d):
    return chunking.file_summary(_units(spark, d))


@query(UNITS_SQL + "SELECT id, CASE WHEN length(coalesce(inferred_type, 'None')) > 20 THEN left(inferred_type, 17) || '...' ELSE coalesce(inferred_type, 'None') END AS type_short, strategy, length(html) AS html_length FROM units")
def chunk_inspection(spark, d):
    return chunking.inspection(_units(spark, d))


_ONE = "SELECT id, max(source_file) AS source_file, max(coalesce(node_ord, -1)) AS node_ord, max(coalesce(part_no, -1)) AS part_no, max(inferred_type) AS inferred_type, max(text) AS text FROM chunks WHERE id IS NOT NULL GROUP BY id"


def _one(spark: SparkSession, d: str, text: bool = False) -> DataFrame:
    """One row per chunk id."""
    more = [F.max("text").alias("text")] if text else []
    return _t(spark, d, "chunks").where("id IS NOT NULL").groupBy("id").agg(F.max("source_file").alias("source_file"), F.max(F.coalesce("node_ord", F.lit(-1))).alias("node_ord"), F.max(F.coalesce("part_no", F.lit(-1))).alias("part_no"), F.max("inferred_type").alias("inferred_type"), *more)


@query(f"""WITH one AS ({_ONE}), p AS (SELECT *, regexp_replace(id, '_[^_]*$', '') AS prefix, row_number() OVER w - 1 AS idx FROM one WINDOW w AS (PARTITION BY source_file ORDER BY node_ord, part_no, id)),
n AS (SELECT *, CASE WHEN prefix = lag(prefix) OVER w THEN 0 ELSE 1 END AS new FROM p WINDOW w AS (PARTITION BY source_file ORDER BY node_ord, part_no, id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY source_file ORDER BY node_ord, part_no, id) AS run FROM n)
SELECT source_file, run::BIGINT AS run, prefix, min(idx)::BIGINT AS start_idx, max(idx)::BIGINT AS end_idx FROM r GROUP BY source_file, run, prefix""")
def chunk_index_ranges(spark, d):
    return chunking.index_ranges(_one(spark, d), "source_file", ("node_ord", "part_no", "id"))


@query(f"WITH one AS ({_ONE}) SELECT id, source_file, ((row_number() OVER (PARTITION BY source_file ORDER BY node_ord, part_no, id) - 1) // 20 + 1)::BIGINT AS batch FROM one")
def batch_assignment(spark, d):
    return chunking.batches(_one(spark, d), ["source_file"], ["node_ord", "part_no", "id"], 20).select("id", "source_file", "batch")


@query(f"""WITH one AS ({_ONE}), b AS (SELECT *, try_cast(regexp_extract(id, '\\.json_(\\d+)_', 1) AS BIGINT) AS book FROM one),
x AS (SELECT *, (row_number() OVER (PARTITION BY source_file, book ORDER BY node_ord, part_no, id) - 1) // 20 + 1 AS part, count(*) OVER (PARTITION BY source_file, book) AS n FROM b)
SELECT id, source_file || '_book' || book || CASE WHEN n > 20 THEN '_part' || part ELSE '' END AS batch_name FROM x""".replace("\\\\", "\\"))
def batch_files(spark, d):
    rows = _one(spark, d).withColumn("book", F.regexp_extract("id", r"\.json_(\d+)_", 1).try_cast("bigint"))
    return sampling.batch_names(rows, "source_file", "book", ["node_ord", "part_no", "id"]).select("id", "batch_name")


@query(f"WITH one AS ({_ONE}) SELECT coalesce(inferred_type, 'None') AS category, arg_min(id, md5(id || ':42')) AS id FROM one GROUP BY ALL")
def one_chunk_per_category(spark, d):
    rows = _one(spark, d).select("id", F.coalesce("inferred_type", F.lit("None")).alias("category"))
    return chunking.one_per_category(rows, "category", 42)


@query(f"WITH one AS ({_ONE}) SELECT id FROM one ORDER BY CASE WHEN inferred_type IN ('chapter', 'novel') THEN 1 ELSE 0 END, md5(id || ':7'), id LIMIT 200")
def test_set_selection(spark, d):
    return sampling.prioritised(_one(spark, d), 200, 7).select("id")


# ---- texts and tokens ----------------------------------------------------------------------

_PLAIN = rf"trim(regexp_replace(regexp_replace(text, '<[^<>]*>', ' ', 'g'), '{_WS}+', ' ', 'g'))"
_STATS = f"""WITH p AS (SELECT *, {_PLAIN} AS plain FROM chunks WHERE text IS NOT NULL),
s AS (SELECT id, source_file AS filename, CASE WHEN inferred_type IN ('chapter', 'novel') THEN 'narrative' ELSE 'meta' END AS unit_type, inferred_type,
  len(regexp_extract_all(plain, '{_NB}+')) AS words_plain, strlen(plain) AS tokens_plain, strlen(text) AS tokens_markup, length(text) - length(replace(text, '<', '')) AS tags_approx FROM p),
stats AS (SELECT *, tokens_markup - tokens_plain AS tokens_overhead, CASE WHEN tokens_plain = 0 THEN 1.0 ELSE round(tokens_markup / tokens_plain, 4) END AS ratio_markup,
  ceil(tokens_markup / 4096)::BIGINT AS chunks_needed_4096, ceil(tokens_markup / 8192)::BIGINT AS chunks_needed_8192, ceil(tokens_markup / 32768)::BIGINT AS chunks_needed_32768, ceil(tokens_markup / 128000)::BIGINT AS chunks_needed_128000 FROM s)
"""


def _stats(spark: SparkSession, d: str) -> DataFrame:
    return textstats.token_stats(_t(spark, d, "chunks"))


@query(_STATS + "SELECT id, filename, unit_type, inferred_type, words_plain, tokens_plain, tokens_markup, tags_approx, tokens_overhead, ratio_markup, chunks_needed_4096, chunks_needed_8192, chunks_needed_32768, chunks_needed_128000 FROM stats")
def token_stats(spark, d):
    return _stats(spark, d)


@query(_STATS + "SELECT filename, unit_type, tokens_plain, tokens_markup, n_chunks, round(CASE WHEN tokens_plain > 0 THEN (tokens_markup - tokens_plain) * 100.0 / tokens_plain ELSE 0 END, 4) AS overhead_percent FROM (SELECT filename, CASE WHEN grouping(unit_type) = 1 THEN 'total' ELSE unit_type END AS unit_type, sum(tokens_plain)::BIGINT AS tokens_plain, sum(tokens_markup)::BIGINT AS tokens_markup, count(*) AS n_chunks FROM stats GROUP BY GROUPING SETS ((filename, unit_type), (filename)))")
def token_stats_by_book(spark, d):
    return textstats.by_book(_stats(spark, d))


_M = ("words_plain", "tokens_plain", "tokens_markup")


@query(_STATS + "SELECT " + ", ".join(f"avg({m}) AS {m}_mean, median({m}) AS {m}_median, min({m}) AS {m}_min, max({m}) AS {m}_max" for m in _M) + " FROM stats WHERE unit_type = 'narrative'")
def chunk_level_summary(spark, d):
    return textstats.chunk_summary(_stats(spark, d))


@query(_STATS + "SELECT count(*) AS n_books, avg(s) AS mean_tokens, median(s) AS median_tokens FROM (SELECT filename, sum(CASE WHEN unit_type = 'narrative' THEN tokens_markup ELSE 0 END)::BIGINT AS s FROM stats GROUP BY 1)")
def book_level_summary(spark, d):
    return textstats.book_summary(_stats(spark, d))


@query(_STATS + "SELECT tokens_markup, min(id) AS id FROM stats WHERE unit_type = 'narrative' AND tokens_markup = (SELECT max(tokens_markup) FROM stats WHERE unit_type = 'narrative') GROUP BY 1")
def largest_chunk(spark, d):
    return textstats.largest(_stats(spark, d))


@query("SELECT CASE WHEN tokens_markup <= 20000 THEN 'not large' WHEN ratio_markup > 3 THEN 'heavy markup' WHEN tokens_markup IS NULL AND ratio_markup IS NULL THEN 'long text' ELSE 'long text' END AS diagnosis, count(*) AS n FROM token_stats_test GROUP BY 1")
def large_chunk_diagnosis(spark, d):
    rows = _t(spark, d, "token_stats_test").select(textstats.diagnosis(F.col("tokens_markup"), F.col("ratio_markup")).alias("diagnosis"))
    return rows.groupBy("diagnosis").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT id, max(strlen(text)) AS tokens FROM chunks WHERE text IS NOT NULL AND id IS NOT NULL GROUP BY id),
t AS (SELECT id, max(tokens_markup) AS tokens_markup, max(chunks_needed_8192) AS needed FROM token_stats_test WHERE id IS NOT NULL GROUP BY id)
SELECT CASE WHEN t.id IS NULL THEN 'no row' WHEN tokens_markup IS NULL THEN 'no measure' WHEN tokens_markup <> tokens THEN 'other size' WHEN needed IS DISTINCT FROM ceil(tokens / 8192)::BIGINT THEN 'other count' ELSE 'agrees' END AS verdict, count(*) AS n FROM c LEFT JOIN t USING (id) GROUP BY 1""")
def token_stats_audit(spark, d):
    c = _t(spark, d, "chunks").where("text IS NOT NULL AND id IS NOT NULL").groupBy("id").agg(F.max(F.octet_length("text").cast("long")).alias("tokens"))
    t = _t(spark, d, "token_stats_test").where("id IS NOT NULL").groupBy("id").agg(F.max("tokens_markup").alias("tokens_markup"), F.max("chunks_needed_8192").alias("needed"), F.lit(1).alias("hit"))
    agrees = F.col("needed").eqNullSafe(textstats.windows_needed(F.col("tokens"), 8192))
    verdict = F.when(F.col("hit").isNull(), "no row").when(F.col("tokens_markup").isNull(), "no measure").when(F.col("tokens_markup") != F.col("tokens"), "other size").when(~agrees, "other count").otherwise("agrees")
    return c.join(t, "id", "left").groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


# the given texts hold no entities; decoding them is tested apart
CLEAN_SQL = r'''trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '<[^>]+>', '', 'g'), '([.!?\p{Nd},:;])([a-zA-Z])', '\1 \2', 'g'), '([a-z])([A-Z])', '\1 \2', 'g'), ''' + f"'{_WS}+', ' ', 'g'))"


@query(f"SELECT id, md5({CLEAN_SQL}) AS clean_md5 FROM chunks")
def clean_text(spark, d):
    return _t(spark, d, "chunks").select("id", F.md5(names.clean_annotation_text(F.col("text"))).alias("clean_md5"))


_TEXT_NODES = r"""string_split_regex(text, '(?s)<!--.*?(?:-->|$)|<[!?][^>]*>|</?[A-Za-z][A-Za-z0-9_:.\-]*(?:"[^"]*"|''[^'']*''|[^''">])*>')"""


@query(f"SELECT id, md5(array_to_string(list_filter(list_transform({_TEXT_NODES}, lambda x: regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g')), lambda x: x <> ''), ' ')) AS text_md5 FROM chunks WHERE text IS NOT NULL")
def visible_text(spark, d):
    rows = textstats.visible_text(_t(spark, d, "chunks").where("text IS NOT NULL"))
    return rows.select("id", F.md5(rows.columns[-1]).alias("text_md5"))


@query(f"SELECT id, CASE WHEN text IS NULL OR NOT regexp_matches(text, '{_NB}') THEN 'no_text' WHEN length(text) > 20000 THEN 'too_long' ELSE 'ok' END AS guard FROM chunks")
def length_guard(spark, d):
    return textstats.overlong(_t(spark, d, "chunks"), 20_000)


@query("SELECT id, md5(CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END) AS preview_md5 FROM chunks")
def html_preview(spark, d):
    return _t(spark, d, "chunks").select("id", F.md5(chunking.preview(F.col("text"))).alias("preview_md5"))


_OPEN = """CASE strategy WHEN 'explicit_chapter' THEN '<div type="chapter">' WHEN 'implicit_chapter_stars' THEN '<div type="chapter" rend="separator">' WHEN 'implicit_chapter_jpg' THEN '<div type="chapter" rend="image-separator">' END"""


@query(UNITS_SQL + f"""SELECT id, md5({_OPEN} || chr(10) || html || chr(10) || '</div>') AS tei_md5, contains(html, '<uncertain>') AS uncertain_found, contains(html, 'type="unknown"') AND strategy = 'non-chapter' AS unknown_type_found FROM units WHERE strategy <> 'novel_no_separator'""")
def tei_wrap(spark, d):
    """Chapters in their div; what is no chapter is only looked at."""
    rows = _units(spark, d).where("strategy <> 'novel_no_separator'")
    uncertain, unknown = tei.quality_flags(F.col("html"), F.col("strategy"))
    wrapped = F.when(F.col("strategy").isin(*tei.OPENING), F.md5(tei.wrap(F.col("html"), F.col("strategy"))))
    return rows.select("id", wrapped.alias("tei_md5"), uncertain.alias("uncertain_found"), unknown.alias("unknown_type_found"))


_PICK = f"""WITH u AS (SELECT id, min(CASE WHEN inferred_type IN ('chapter', 'novel') THEN 1 ELSE 0 END) AS p FROM ({_ONE}) GROUP BY id), s AS (SELECT id FROM u ORDER BY p, md5(id || ':7'), id LIMIT 200)
"""


@query(_PICK + "SELECT id, batch, 'gold_chunks_part_' || printf('%02d', batch) || '.json' AS file_name FROM (SELECT id, ((row_number() OVER (ORDER BY md5(id || ':8'), id) - 1) // 20 + 1)::BIGINT AS batch FROM s)")
def selection_batches(spark, d):
    return sampling.selection_batches(_one(spark, d), 200, 7)


@query(UNITS_SQL + """SELECT id AS chunk_id, CASE strategy WHEN 'novel_no_separator' THEN 'Skipped' ELSE 'Success' END AS status, strategy, CASE WHEN strategy = 'novel_no_separator' THEN 'None' WHEN strategy = 'non-chapter' THEN 'LLM-Wrapped' ELSE 'Script-Wrapped' END AS wrapped_div,
  CASE strategy WHEN 'non-chapter' THEN 'YES (<div type=''unknown''>)' ELSE 'no' END AS unknown_type_found FROM units""")
def tei_run_log(spark, d):
    """The log of a run of the rule-based stand-in over all work units."""
    log = tei_run.run(_units(spark, d), F.current_timestamp())[1]
    return log.select("chunk_id", "status", "strategy", "wrapped_div", "unknown_type_found")


@query()
def tei_run_output(spark, d):
    return tei_run.run(_units(spark, d), F.current_timestamp())[0]


@query(r"""SELECT source_file, trim(regexp_replace(translate(source_file, '/\:', '__-'), '[*?"<>|]', '', 'g'), '. ') AS safe, translate(source_file, '/\:', '__-') <> source_file AS changed, regexp_replace(source_file, '[^\p{L}\p{N} ]', '', 'g') AS title FROM (SELECT DISTINCT source_file FROM chunks)""")
def safe_ids(spark, d):
    f = F.col("source_file")
    return _t(spark, d, "chunks").select("source_file").distinct().select("source_file", names.filesystem_safe(f).alias("safe"), (F.translate(f, "/\\:", "__-") != f).alias("changed"), names.safe_title(f).alias("title"))
