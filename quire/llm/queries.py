"""Queries of the training-data operators; each reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import consensus, markup, mixing, packing, pieces, sitelines, stratified, truncation
from quire.plans.runtime import read_table as _t


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.find_markup(_t(spark, d, "documents"))


def p1_plain_text(spark: SparkSession, d: str) -> DataFrame:
    return markup.extract_plain_text(_t(spark, d, "documents"))


def p1_templates(spark: SparkSession, d: str) -> DataFrame:
    return markup.deduce_templates(_t(spark, d, "documents"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pieces.find_oversized(_t(spark, d, "chunks"), _t(spark, d, "token_windows"))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.split_oversized(_t(spark, d, "chunks"), 8192, pieces.window_overlap(_t(spark, d, "token_windows"), 8192))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return sitelines.find_repeated_lines(_t(spark, d, "documents"), _t(spark, d, "book_json"))


def p3_own_text(spark: SparkSession, d: str) -> DataFrame:
    items = sitelines.all_items(_t(spark, d, "documents"), _t(spark, d, "book_json"))
    return sitelines.remove_repeated(items, sitelines.mine_templates(items))


def p3_templates(spark: SparkSession, d: str) -> DataFrame:
    mined = sitelines.mine_templates(sitelines.all_items(_t(spark, d, "documents"), _t(spark, d, "book_json")))
    return mined.select("origin", "grp", "template", "n_items", "n_group")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return consensus.find_wrong_gold(_t(spark, d, "eval_results"), _t(spark, d, "annotations"), _t(spark, d, "label_set"))


def _votes(spark: SparkSession, d: str) -> DataFrame:
    return consensus.all_votes(_t(spark, d, "eval_results"), _t(spark, d, "annotations"))


def p4_consensus(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus(_votes(spark, d), _t(spark, d, "label_set"))


def p4_reliability(spark: SparkSession, d: str) -> DataFrame:
    return consensus.labeller_report(_votes(spark, d), _t(spark, d, "label_set"))


def p4_agreement(spark: SparkSession, d: str) -> DataFrame:
    out = consensus.agreement(_votes(spark, d), _t(spark, d, "label_set"))
    return out.select("n_items", "n_votes", *(F.round(c, 9).alias(c) for c in ("observed", "expected", "alpha")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return stratified.find_short_strata(_t(spark, d, "sample_data"), _t(spark, d, "sample_targets"))


def p5_sample(spark: SparkSession, d: str) -> DataFrame:
    return stratified.draw_sample(_t(spark, d, "sample_data"), _t(spark, d, "sample_targets"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return stratified.strata_report(_t(spark, d, "sample_data"), _t(spark, d, "sample_targets"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.find_split(_t(spark, d, "documents"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_t(spark, d, "documents"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.report(packing.pack(_t(spark, d, "documents")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.find_short_sources(_t(spark, d, "documents"), _t(spark, d, "mix_targets"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_t(spark, d, "documents"), _t(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(_t(spark, d, "documents"), _t(spark, d, "mix_targets"))


def p8_capacity(spark: SparkSession, d: str) -> DataFrame:
    return mixing.source_capacity(_t(spark, d, "documents"), _t(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.find_truncated(_t(spark, d, "documents"))


def p9_judged(spark: SparkSession, d: str) -> DataFrame:
    return truncation.judge(_t(spark, d, "documents"))


def p9_by_source(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_by_source(_t(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_plain_text, p1_templates, p2_found, p2_pieces, p3_found, p3_own_text, p3_templates, p4_found, p4_consensus, p4_reliability, p4_agreement, p5_found, p5_sample, p5_report, p7_found, p7_containers, p7_report, p8_found, p8_mix, p8_shares, p8_capacity, p9_found, p9_judged, p9_by_source)
}

_LINES = r"""
WITH docs AS (SELECT 'documents' AS origin, coalesce(lower(trim(source)), '') AS grp, doc_id AS item_id, text FROM documents WHERE text IS NOT NULL),
books AS (
  SELECT 'book_json' AS origin, coalesce(lower(trim(portal)), '') AS grp, record_id AS item_id,
    CASE json_type(body, '$.epub_metadata.description')
      WHEN 'VARCHAR' THEN json_extract_string(body, '$.epub_metadata.description')
      WHEN 'ARRAY' THEN array_to_string(json_extract_string(body, '$.epub_metadata.description[*]'), chr(10))
      ELSE '' END AS text
  FROM book_json WHERE body IS NOT NULL AND json_valid(body)),
items AS (SELECT * FROM docs UNION ALL SELECT * FROM books),
n AS (SELECT origin, grp, count(*) AS n_group FROM items GROUP BY ALL),
lines AS (SELECT origin, grp, item_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM items),
masked AS (SELECT *, regexp_replace(lower(trim(regexp_replace(line, '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0B}\x{1C}-\x{1F}]+', ' ', 'g'))), '[0-9]+', '0', 'g') AS k FROM lines),
long AS (SELECT * FROM masked WHERE length(regexp_replace(k, '[^\p{L}]', '', 'g')) >= 20),
counts AS (SELECT origin, grp, k, count(DISTINCT item_id) AS c FROM long GROUP BY ALL)
"""

SQL: dict[str, str] = {
    "p2_found": "SELECT DISTINCT id FROM chunks WHERE strlen(text) > 8192",
    "p3_found": _LINES + "SELECT DISTINCT origin, item_id, line_no FROM long JOIN counts USING (origin, grp, k) JOIN n USING (origin, grp) WHERE c >= 5 AND c * 100 >= 3 * n_group",
    "p3_templates": _LINES + "SELECT origin, grp, k AS template, c AS n_items, n_group FROM counts JOIN n USING (origin, grp) WHERE c >= 5 AND c * 100 >= 3 * n_group",
    "p4_agreement": r"""
WITH lab AS (SELECT label FROM label_set),
m AS (SELECT DISTINCT id, 'openai_gpt_oss_120b' AS labeller, openai_gpt_oss_120b AS l FROM eval_results
  UNION ALL SELECT DISTINCT id, 'deepseek_deepseek_v3_2', deepseek_deepseek_v3_2 FROM eval_results
  UNION ALL SELECT DISTINCT id, 'moonshotai_kimi_k2_0905', moonshotai_kimi_k2_0905 FROM eval_results),
mv AS (SELECT id, labeller, max(regexp_replace(lower(trim(l)), '[_\s]+', '-', 'g')) AS label FROM m WHERE l IS NOT NULL AND trim(l) <> '' GROUP BY ALL),
av AS (SELECT id, annotator AS labeller, regexp_replace(lower(trim(gold_label)), '[_\s]+', '-', 'g') AS label FROM annotations
  WHERE gold_label IS NOT NULL AND id IS NOT NULL AND annotator IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id, annotator ORDER BY labelled_at DESC, annotation_id DESC) = 1),
v AS (SELECT * FROM mv UNION ALL SELECT * FROM av),
c AS (SELECT id, label, count(*) AS c FROM v WHERE label IN (SELECT label FROM lab) GROUP BY ALL),
i AS (SELECT id, sum(c) AS n, sum(c * (c - 1)) AS same FROM c GROUP BY id HAVING sum(c) > 1),
o AS (SELECT sum(n) AS n_votes, count(*) AS n_items, 1 - sum(same / (n - 1)) / sum(n) AS observed FROM i),
t AS (SELECT label, sum(c) AS c FROM c WHERE id IN (SELECT id FROM i) GROUP BY label),
e AS (SELECT 1 - sum(c * (c - 1)) / (sum(c) * (sum(c) - 1)) AS expected FROM t)
SELECT n_items, n_votes::BIGINT AS n_votes, round(observed, 9) AS observed, round(expected, 9) AS expected, round(1 - observed / expected, 9) AS alpha FROM o, e""",
    "p5_found": """
WITH k AS (SELECT count(DISTINCT id) // 10 AS k FROM sample_data),
s AS (SELECT DISTINCT id, lower(trim(publisher_tier)) AS t, lower(trim(series_size_category)) AS c FROM sample_data),
h AS (SELECT g.publisher_tier, g.series_size_category, g.min_books, g.target_pct, count(DISTINCT s.id) AS n
  FROM sample_targets g LEFT JOIN s ON s.t = lower(g.publisher_tier) AND s.c = lower(g.series_size_category) GROUP BY ALL)
SELECT publisher_tier, series_size_category FROM h, k WHERE n < greatest(min_books, ceil(target_pct * k / 100.0))""",
    "p7_found": "SELECT doc_id FROM documents WHERE strlen(text) > 4096",
    "p8_found": """
WITH t AS (SELECT sum(strlen(text)) AS total FROM documents),
s AS (SELECT lower(trim(source)) AS source, sum(strlen(text)) AS tokens FROM documents GROUP BY 1)
SELECT m.source FROM mix_targets m LEFT JOIN s ON s.source = lower(trim(m.source)), t
WHERE coalesce(tokens, 0) * max_repeats * 1000 < target_permille * total""",
    "p8_capacity": """
WITH t AS (SELECT sum(strlen(text))::BIGINT AS total FROM documents),
s AS (SELECT lower(trim(source)) AS source, sum(strlen(text))::BIGINT AS tokens, count(text) AS n_docs FROM documents WHERE text IS NOT NULL GROUP BY 1)
SELECT m.source, target_permille, max_repeats, coalesce(n_docs, 0) AS n_docs, coalesce(tokens, 0) AS tokens, total AS total_tokens,
  (target_permille * total // 1000)::BIGINT AS quota_tokens, coalesce(tokens, 0) * max_repeats * 1000 >= target_permille * total AS reachable
FROM mix_targets m LEFT JOIN s ON s.source = lower(trim(m.source)), t""",
}
