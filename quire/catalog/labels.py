"""Label joins, evaluation metrics and model runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.catalog.chunks import CLEAN_SQL
from quire.catalog.registry import query
from quire.functions import names
from quire.operators import classify, evaluation, labels
from quire.plans.runtime import read_table as _t

MODELS = ("openai_gpt_oss_120b", "deepseek_deepseek_v3_2", "moonshotai_kimi_k2_0905", "inferred_type")
_STRIP = r"regexp_replace({}, '^[\s\x{{A0}}]+|[\s\x{{A0}}]+$', '', 'g')"
_LONG = "WITH one AS (SELECT * FROM eval_results QUALIFY row_number() OVER (PARTITION BY id ORDER BY id) = 1), r AS (" + " UNION ALL ".join(f"SELECT id, '{m}' AS model, lower({_STRIP.format('gold_label')}) AS gold, lower({_STRIP.format(m)}) AS pred FROM one" for m in MODELS) + "), long AS (SELECT * FROM r WHERE gold IS NOT NULL AND pred IS NOT NULL AND pred <> ''{more})\n"
_L = _LONG.replace("{more}", "")
_REPORT = """, c AS (SELECT model, gold, pred, count(*) AS n FROM {long} GROUP BY ALL),
b AS (SELECT model, gold AS label, n, 0 AS p, CASE WHEN gold = pred THEN n ELSE 0 END AS tp FROM c UNION ALL SELECT model, pred, 0, n, 0 FROM c),
g AS (SELECT model, label, sum(n) AS s, sum(p) AS p, sum(tp) AS tp FROM b GROUP BY ALL),
rep AS (SELECT model, label, CASE WHEN p = 0 THEN 0 ELSE tp / p END AS precision, CASE WHEN s = 0 THEN 0 ELSE tp / s END AS recall, 2.0 * tp / (s + p) AS f1, s AS support FROM g),
su AS (SELECT model, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf, sum(f1 * support) / sum(support) AS wf, sum(precision * support) / sum(support) AS wp, sum(recall * support) / sum(support) AS acc, sum(support)::BIGINT AS samples FROM rep GROUP BY model)
"""
_BOARD = "SELECT model, CASE WHEN model = 'inferred_type' THEN 'Rule' ELSE 'LLM' END AS kind, round(acc, 9) AS accuracy, round(mp, 9) AS macro_precision, round(mr, 9) AS macro_recall, round(mf, 9) AS macro_f1, round(wf, 9) AS weighted_f1, samples FROM su"


def _long(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.long_results(_t(spark, d, "eval_results"), MODELS)


@query(_L + _REPORT.format(long="long") + _BOARD)
def model_leaderboard(spark, d):
    return evaluation.leaderboard(_long(spark, d))


@query(_LONG.replace("{more}", " AND gold <> 'chapter'") + _REPORT.format(long="long") + _BOARD)
def leaderboard_without_class(spark, d):
    return evaluation.leaderboard(_long(spark, d).where("gold <> 'chapter'"))


@query(_L + ", ms AS (SELECT * FROM long QUALIFY count(*) OVER (PARTITION BY model, gold) >= 8)" + _REPORT.format(long="ms") + _BOARD)
def leaderboard_min_support(spark, d):
    return evaluation.leaderboard(evaluation.min_support(_long(spark, d), 8))


@query(_L + _REPORT.format(long="long") + """SELECT model, label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support::DOUBLE AS support FROM rep
UNION ALL SELECT model, 'accuracy', round(acc, 9), round(acc, 9), round(acc, 9), round(acc, 9) FROM su UNION ALL SELECT model, 'macro avg', round(mp, 9), round(mr, 9), round(mf, 9), samples FROM su
UNION ALL SELECT model, 'weighted avg', round(wp, 9), round(acc, 9), round(wf, 9), samples FROM su""")
def classification_report(spark, d):
    return evaluation.report_frame(_long(spark, d))


_GRID = _L + ", c AS (SELECT model, gold, pred, count(*) AS n FROM long GROUP BY ALL), l AS (SELECT model, gold AS l FROM c UNION SELECT model, pred FROM c), cm AS (SELECT a.model, a.l AS gold, b.l AS pred, coalesce(n, 0) AS n FROM l a JOIN l b ON a.model = b.model LEFT JOIN c ON c.model = a.model AND c.gold = a.l AND c.pred = b.l)\n"


@query(_GRID + "SELECT model, gold, pred, n FROM cm")
def confusion_matrix(spark, d):
    return evaluation.confusion(_long(spark, d))


@query(_GRID + "SELECT model, gold, pred, CASE WHEN sum(n) OVER w > 0 THEN n / sum(n) OVER w ELSE 0.0 END AS share FROM cm WINDOW w AS (PARTITION BY model, gold)")
def confusion_relative(spark, d):
    return evaluation.confusion_relative(evaluation.confusion(_long(spark, d)))


@query(_GRID + "SELECT model, gold, pred, round((n + 1e-10) / (sum(n) OVER (PARTITION BY model, gold) + 1e-10), 9) AS share FROM cm")
def confusion_relative_compat(spark, d):
    return evaluation.confusion_relative(evaluation.confusion(_long(spark, d)), compat=True).withColumn("share", F.round("share", 9))


@query(f"SELECT lower({_STRIP.format('gold_label')}) AS label, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent FROM eval_results WHERE gold_label IS NOT NULL GROUP BY 1")
def label_distribution(spark, d):
    return evaluation.distribution(_t(spark, d, "eval_results").select(labels.normalise(F.col("gold_label")).alias("g")), "g")


@query("SELECT coalesce(gold_label_subtype, 'none') AS label, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent FROM annotations GROUP BY 1")
def subtype_distribution(spark, d):
    return evaluation.distribution(_t(spark, d, "annotations").select(F.coalesce("gold_label_subtype", F.lit("none")).alias("g")), "g")


@query("WITH g AS (SELECT id, max(gold_label) AS gold_label FROM eval_results GROUP BY id) SELECT c.id, CASE WHEN gold_label <> '' THEN gold_label END AS gold_label, CASE WHEN gold_label <> '' THEN 'OK' ELSE 'MISSING' END AS status FROM (SELECT DISTINCT id FROM chunks) c LEFT JOIN g USING (id)")
def label_join_status(spark, d):
    return labels.join_status(_t(spark, d, "chunks"), _t(spark, d, "eval_results"))


@query(" UNION ALL ".join(f"SELECT '{m}' AS model, count({m}) AS done, count(*) - count({m}) AS remaining FROM eval_results" for m in MODELS))
def remaining_work(spark, d):
    return labels.remaining(_t(spark, d, "eval_results"), MODELS)


@query("SELECT id, arg_max(gold_label, struct_pack(a := labelled_at, b := exported_at, c := annotation_id)) AS gold_label FROM annotations WHERE gold_label IS NOT NULL GROUP BY id")
def last_wins_merge(spark, d):
    return labels.last_wins(_t(spark, d, "annotations").where("gold_label IS NOT NULL"), "id", "gold_label", ["labelled_at", "exported_at", "annotation_id"])


@query("SELECT id, gold_label FROM eval_results UNION ALL SELECT id, NULL FROM (SELECT DISTINCT id FROM chunks WHERE id IS NOT NULL) c WHERE id NOT IN (SELECT id FROM eval_results WHERE id IS NOT NULL)")
def append_new_ids(spark, d):
    new = _t(spark, d, "chunks").where("id IS NOT NULL").select("id").distinct()
    return labels.append_new(_t(spark, d, "eval_results").select("id", "gold_label"), new)


@query("WITH c AS (SELECT DISTINCT replace(id, '.json', '') AS k FROM chunks WHERE id IS NOT NULL), g AS (SELECT DISTINCT replace(id, '.json', '') AS k FROM eval_results) SELECT count(*) AS n_ids, count(g.k) AS labelled, count(*) - count(g.k) AS unlabelled FROM c LEFT JOIN g USING (k)")
def labelled_count(spark, d):
    return labels.labelled_hits(_t(spark, d, "chunks"), _t(spark, d, "eval_results"))


@query(r"""SELECT id, CASE WHEN regexp_matches(id, '^(.+)_(\d+)_(\d+)$') THEN regexp_extract(id, '^(.+)_(\d+)_(\d+)$', 1) END AS file, try_cast(nullif(regexp_extract(id, '^(.+)_(\d+)_(\d+)$', 2), '') AS BIGINT) AS book, try_cast(nullif(regexp_extract(id, '^(.+)_(\d+)_(\d+)$', 3), '') AS BIGINT) AS chunk, CASE WHEN regexp_matches(id, '^(.*?\.json)_(\d+)_(\d+)(?:_.*)?$') THEN regexp_extract(id, '^(.*?\.json)_(\d+)_(\d+)(?:_.*)?$', 1) END AS token_file FROM (SELECT DISTINCT id FROM chunks)""")
def parse_ids(spark, d):
    file, book, chunk, token = labels.parse_chunk_id(F.col("id"))
    return _t(spark, d, "chunks").select("id").distinct().select("id", file.alias("file"), book.alias("book"), chunk.alias("chunk"), token.alias("token_file"))


@query("SELECT id, openai_gpt_oss_120b, deepseek_deepseek_v3_2, openai_gpt_oss_120b IS NOT DISTINCT FROM deepseek_deepseek_v3_2 AS label_match, openai_gpt_oss_120b_subtype IS NOT DISTINCT FROM deepseek_deepseek_v3_2_subtype AS subtype_match, openai_gpt_oss_120b IS NOT DISTINCT FROM deepseek_deepseek_v3_2 AND openai_gpt_oss_120b_subtype IS NOT DISTINCT FROM deepseek_deepseek_v3_2_subtype AS full_match FROM eval_results")
def run_agreement(spark, d):
    return labels.agreement_of(_t(spark, d, "eval_results"), "openai_gpt_oss_120b", "deepseek_deepseek_v3_2")


_SET = ", ".join(f"'{x}'" for x in labels.LABELS)
_SUB = ", ".join(f"'{x}'" for x in labels.SUBTYPES)


@query(f"SELECT annotation_id, CASE WHEN gold_label IN ({_SET}) THEN gold_label ELSE 'unknown' END AS label, CASE WHEN gold_label = 'reader-information' AND gold_label_subtype IN ({_SUB}) THEN gold_label_subtype END AS subtype, CASE WHEN gold_label = 'reader-information' AND gold_label_subtype IS NOT NULL THEN gold_label_subtype ELSE 'none' END AS run_subtype FROM annotations")
def label_validation(spark, d):
    label, subtype = labels.validate(F.col("gold_label"), F.col("gold_label_subtype"))
    return _t(spark, d, "annotations").select("annotation_id", label.alias("label"), subtype.alias("subtype"), labels.subtype_rule(F.col("gold_label"), F.col("gold_label_subtype")).alias("run_subtype"))


@query("SELECT id, openai_gpt_oss_120b AS label FROM eval_results WHERE openai_gpt_oss_120b IS NOT NULL")
def llm_json_parse(spark, d):
    """Model answers in four forms, made from the labels, and parsed back."""
    j = F.to_json(F.struct(F.col("openai_gpt_oss_120b").alias("label")))
    form = F.pmod(F.xxhash64("id"), F.lit(4))
    answer = F.when(form == 0, j).when(form == 1, F.concat(F.lit("```json\n"), j, F.lit("\n```"))).when(form == 2, F.concat(F.lit("Sure, here it is: "), j)).otherwise(F.concat(F.lit("Answer: "), j, F.lit(" Done.")))
    rows = _t(spark, d, "eval_results").where("openai_gpt_oss_120b IS NOT NULL").select("id", labels.json_answer(answer).alias("j"))
    return rows.select("id", F.get_json_object("j", "$.label").alias("label"))


@query("SELECT model, error, count(*) AS n FROM (SELECT 'openai_gpt_oss_120b' AS model, lower(trim(openai_gpt_oss_120b)) AS error FROM eval_results UNION ALL SELECT 'inferred_type', lower(trim(inferred_type)) FROM eval_results) WHERE error IN ('no_text', 'too_long', 'encoding_error', 'parsing_error', 'batch_error') GROUP BY ALL")
def error_breakdown(spark, d):
    return labels.error_breakdown(_t(spark, d, "eval_results"), ("openai_gpt_oss_120b", "inferred_type"))


@query("SELECT id, model, label, subtype FROM (" + " UNION ALL ".join(f"SELECT id, '{m}' AS model, {m} AS label, {m}_subtype AS subtype FROM eval_results" for m in MODELS[:3]) + ")")
def results_long(spark, d):
    return classify.models_long(_t(spark, d, "eval_results"), MODELS[:3])


@query(r"""WITH t AS (SELECT id, max(text) AS text FROM chunks WHERE id IS NOT NULL GROUP BY id),
g AS (SELECT id, text, lower(text) AS low, CASE WHEN NOT coalesce(regexp_matches(text, '[^\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0B}]'), false) THEN 'no_text' WHEN length(text) > 100000 THEN 'too_long' END AS guard FROM t)
SELECT id, coalesce(guard, CASE WHEN contains(low, '<graphic') AND length(text) < 400 THEN 'cover-image' WHEN len(regexp_extract_all(low, '<item|<ref')) > 4 THEN 'toc'
  WHEN contains(low, 'isbn') OR contains(low, 'impressum') OR contains(low, 'verlag') THEN 'imprint' WHEN length(text) > 1500 THEN 'chapter' ELSE 'unknown' END) AS label, CASE WHEN guard IS NULL THEN 'Success' ELSE 'Skipped' END AS status FROM g""")
def classify_chunks(spark, d):
    """The rule-based stub behind the model interface, over all chunks."""
    return classify.run_model(_t(spark, d, "chunks")).select("id", "label", "status")


@query("SELECT DISTINCT id FROM chunks WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM eval_results WHERE id IS NOT NULL)")
def pending_chunks(spark, d):
    return classify.pending(_t(spark, d, "chunks").where("id IS NOT NULL"), _t(spark, d, "eval_results")).select("id").distinct()


@query(f"WITH c AS (SELECT id, max(text) AS text FROM chunks GROUP BY id) SELECT annotation_id, a.id, gold_label AS old_gold_label, md5({CLEAN_SQL}) AS text_md5 FROM annotations a LEFT JOIN c USING (id)")
def annotation_view(spark, d):
    """Annotation rows with the clean text of their chunk, empty where there is none."""
    rows = labels.with_text(_t(spark, d, "annotations").withColumnRenamed("gold_label", "old_gold_label"), _t(spark, d, "chunks"))
    return rows.select("annotation_id", "id", "old_gold_label", F.md5(names.clean_annotation_text(F.col("chunk_text"))).alias("text_md5"))


@query("SELECT source_file AS batch, max(strlen(text)) AS max_tokens, avg(strlen(text)) AS avg_tokens, sum(strlen(text))::BIGINT AS sum_tokens FROM chunks GROUP BY 1")
def batch_token_stats(spark, d):
    return classify.batch_token_stats(_t(spark, d, "chunks"), F.octet_length("text").cast("long"), F.col("source_file"))


@query("SELECT id, strlen('" + classify.PROMPT + "' || text) > 8192 AS over_context FROM chunks WHERE text IS NOT NULL")
def context_check(spark, d):
    rows = _t(spark, d, "chunks").where("text IS NOT NULL").select("id", classify.build_prompt(F.col("text")).alias("prompt"))
    return classify.context_check(rows, 8192, F.octet_length).select("id", "over_context")


@query("SELECT DISTINCT id, lower(trim(inferred_type)) AS error FROM eval_results WHERE lower(trim(inferred_type)) IN ('parsing_error', 'batch_error', 'encoding_error')")
def failed_ids(spark, d):
    return labels.failed_ids(_t(spark, d, "eval_results"), "inferred_type")


@query(r"""WITH t AS (SELECT id, max(text) AS text FROM chunks WHERE id IS NOT NULL GROUP BY id)
SELECT r.id, md5(text) AS text_md5, NOT coalesce(regexp_matches(text, '[^\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0B}]'), false) AS no_text FROM (SELECT DISTINCT id FROM eval_results) r LEFT JOIN t USING (id)""")
def results_with_text(spark, d):
    rows = labels.with_text(_t(spark, d, "eval_results").select("id").distinct(), _t(spark, d, "chunks"))
    return rows.select("id", F.md5("chunk_text").alias("text_md5"), "no_text")


@query("SELECT model, id FROM (" + " UNION ".join(f"SELECT '{m}' AS model, id FROM eval_results WHERE {m} IS NULL AND id IS NOT NULL" for m in MODELS) + ") QUALIFY row_number() OVER (PARTITION BY model ORDER BY id) <= 25")
def first_pending_per_model(spark, d):
    """The first ids without an answer of each model."""
    rows = _t(spark, d, "eval_results").where("id IS NOT NULL").select("id", F.explode(F.array(*(F.when(F.col(m).isNull(), F.lit(m)) for m in MODELS))).alias("model"))
    return labels.first_per_model(rows.where("model IS NOT NULL").distinct(), 25).select("model", "id")


@query(r"""WITH p AS (SELECT annotation_id, CASE WHEN regexp_matches(id, '^(.+)_(\d+)_(\d+)$') THEN regexp_extract(id, '^(.+)_(\d+)_(\d+)$', 1) END AS f, try_cast(nullif(regexp_extract(id, '^(.+)_(\d+)_(\d+)$', 2), '') AS BIGINT) AS s, try_cast(nullif(regexp_extract(id, '^(.+)_(\d+)_(\d+)$', 3), '') AS BIGINT) AS c FROM annotations)
SELECT annotation_id, f AS book_file, s AS section_idx, c AS chunk_idx, row_number() OVER (ORDER BY f NULLS FIRST, s NULLS FIRST, c NULLS FIRST, annotation_id) AS place FROM p""")
def annotation_order(spark, d):
    return labels.in_book_order(_t(spark, d, "annotations").select("annotation_id", "id"), "annotation_id").drop("id")
