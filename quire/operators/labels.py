"""Label joins, identifiers, model answers and runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import unicode_strip
from quire.plans.runtime import cut, join_checked, numbered

#: Allowed labels, subtypes valid under reader-information, and the sentinels of failed runs.
LABELS = ("cover-image", "title-page", "imprint", "toc", "chapter", "feedback", "author-information", "reader-information", "unknown")
SUBTYPES = ("meta-information", "advertisement", "editorial", "preview", "dedication", "castlist", "framing", "other")
SENTINELS = ("no_text", "too_long", "encoding_error", "parsing_error", "batch_error")


def normalise(label: Column) -> Column:
    """Stripped of Unicode white space, lower case. Spelling is left as it is."""
    return F.lower(unicode_strip(label))


def last_wins(rows: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """Of equal keys the value that comes last; a map-side aggregate."""
    return rows.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def join_status(chunks: DataFrame, labels: DataFrame, key: str = "id", label: str = "gold_label") -> DataFrame:
    """Chunks with label and OK or MISSING; an empty label is missing."""
    one = labels.groupBy(key).agg(F.max(label).alias(label))
    ok = F.col(label).isNotNull() & (F.col(label) != "")
    return chunks.select(key).distinct().join(one, key, "left").select(key, F.when(ok, F.col(label)).alias(label), F.when(ok, "OK").otherwise("MISSING").alias("status"))


def remaining(results: DataFrame, models: Sequence[str]) -> DataFrame:
    """Done and remaining ids per model; one pass for all models."""
    one = results.agg(F.count("*").alias("total"), *(F.count(F.col(f"`{m}`")).alias(f"d{i}") for i, m in enumerate(models)))
    entries = [F.struct(F.lit(m).alias("model"), F.col(f"d{i}").alias("done"), (F.col("total") - F.col(f"d{i}")).alias("remaining")) for i, m in enumerate(models)]
    return one.select(F.inline(F.array(*entries)))


def append_new(results: DataFrame, gold: DataFrame, key: str = "id") -> DataFrame:
    """Results with the gold rows whose id they lack."""
    return results.unionByName(gold.join(results.select(key), key, "left_anti"), allowMissingColumns=True)


def labelled_hits(ids: DataFrame, gold: DataFrame, key: str = "id") -> DataFrame:
    """How many distinct ids are labelled and how many not, '.json' left aside on both sides."""
    strip = F.replace(F.col(key), F.lit(".json"), F.lit(""))
    mine = ids.select(strip.alias("k")).where("k IS NOT NULL").distinct()
    known = gold.select(strip.alias("k")).where("k IS NOT NULL").distinct().withColumn("hit", F.lit(1))
    return mine.join(known, "k", "left").agg(F.count("*").alias("n_ids"), F.count("hit").alias("labelled"), (F.count("*") - F.count("hit")).alias("unlabelled"))


def parse_chunk_id(chunk_id: Column) -> tuple[Column, Column, Column, Column]:
    """(file, book, chunk) by the greedy rule, null where it fails; and the file by the token rule, which accepts suffixes."""
    greedy = r"^(.+)_(\d+)_(\d+)$"
    ok = chunk_id.rlike(greedy)
    file = F.when(ok, F.regexp_extract(chunk_id, greedy, 1))
    book = F.when(ok, F.regexp_extract(chunk_id, greedy, 2).cast("long"))
    chunk = F.when(ok, F.regexp_extract(chunk_id, greedy, 3).cast("long"))
    token = r"^(.*?\.json)_(\d+)_(\d+)(?:_.*)?$"
    return file, book, chunk, F.when(chunk_id.rlike(token), F.regexp_extract(chunk_id, token, 1))


def agreement_of(results: DataFrame, a: str, b: str, key: str = "id") -> DataFrame:
    """Per id whether two runs agree on label, on subtype, and on both; nulls agree with nulls."""
    label = F.col(a).eqNullSafe(F.col(b))
    subtype = F.col(f"{a}_subtype").eqNullSafe(F.col(f"{b}_subtype"))
    return results.select(key, a, b, label.alias("label_match"), subtype.alias("subtype_match"), (label & subtype).alias("full_match"))


def validate(label: Column, subtype: Column) -> tuple[Column, Column]:
    """An unknown label becomes 'unknown'; a subtype is null unless under reader-information and known."""
    ok = F.when(label.isin(*LABELS), label).otherwise("unknown")
    return ok, F.when((ok == "reader-information") & subtype.isin(*SUBTYPES), subtype)


def subtype_rule(label: Column, subtype: Column) -> Column:
    """The API run's rule: 'none' unless under reader-information and given; the label isn't validated."""
    return F.when((label == "reader-information") & subtype.isNotNull(), subtype).otherwise("none")


def json_answer(answer: Column, last_brace: bool = False) -> Column:
    """The JSON object in a model's answer as a string, null if none parses.

    Tried in turn: the whole answer, what stands between fences, block by block, and the brace span: from the first
    brace to the last, or with last_brace from the last opening brace to the next closing one. A block may begin with
    any of the letters of 'json'.
    """
    def valid(s: Column) -> Column:
        # alone in an array, so that text after the object isn't overlooked
        return F.when(F.json_object_keys(s).isNotNull() & (F.json_array_length(F.concat(F.lit("["), s, F.lit("]"))) == 1), s)

    blocks = F.transform(F.split(answer, "```"), lambda b: unicode_strip(F.regexp_replace(unicode_strip(b), r"^[json]+", "")))
    fenced = F.when(F.contains(answer, F.lit("```")), F.try_element_at(F.array_compact(F.transform(blocks, valid)), F.lit(1)))
    span = F.regexp_extract(answer, r"(?s)(\{[^{}]*\})[^{]*$" if last_brace else r"(?s)(\{.*\})", 1)
    return F.coalesce(valid(unicode_strip(answer)), fenced, valid(span))


def error_breakdown(results: DataFrame, models: Sequence[str]) -> DataFrame:
    """Sentinel counts per model."""
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.col(m).alias("label")) for m in models)))
    rows = results.select(pairs.alias("p")).select("p.model", normalise(F.col("p.label")).alias("error"))
    return rows.where(F.col("error").isin(*SENTINELS)).groupBy("model", "error").agg(F.count("*").alias("n"))


#: Labels after which a chunk counts as failed.
FAILED = ("parsing_error", "batch_error", "encoding_error")


def in_book_order(rows: DataFrame, unique: str) -> DataFrame:
    """Rows with their place in order of book file, section and chunk of their id, ties by a unique column; ids of
    another form, without file, come first."""
    file, section, chunk, _ = parse_chunk_id(F.col("id"))
    placed = rows.select("*", file.alias("book_file"), section.alias("section_idx"), chunk.alias("chunk_idx"))
    return numbered(placed, ["book_file", "section_idx", "chunk_idx", unique], "place")


def failed_ids(results: DataFrame, model: str) -> DataFrame:
    """Ids whose label by the model is an error, with the error."""
    error = normalise(F.col(f"`{model}`"))
    return results.select("id", error.alias("error")).where(F.col("error").isin(*FAILED)).distinct()


def with_text(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """Results with the text of their chunk and whether there is none; of an id's texts the greatest holds. Only the
    texts of ids that have results are moved, where their ids are few enough to be sent to the tasks."""
    wanted = cut(results.where("id IS NOT NULL").select("id").distinct(), "wanted")
    texts = join_checked(chunks, wanted, ["id"], "left_semi").groupBy("id").agg(F.max("text").alias("chunk_text"))
    return results.join(texts, "id", "left").withColumn("no_text", ~F.coalesce(F.col("chunk_text").rlike(r"(?U)\S"), F.lit(False)))


def first_per_model(pending: DataFrame, k: int, model: str = "model", key: str = "id") -> DataFrame:
    """The first k ids to do of each model, in order of ids; the limit is a constant, so each task gives away k rows a model."""
    w = Window.partitionBy(model).orderBy(key)
    return pending.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def insert_after(columns: Sequence[str], new: str, after: str) -> list[str]:
    """Column order with `new` right after `after`, at the end if that is absent."""
    rest = [c for c in columns if c != new]
    k = rest.index(after) + 1 if after in rest else len(rest)
    return rest[:k] + [new] + rest[k:]


def drop_matching(df: DataFrame, *parts: str) -> DataFrame:
    """Without the columns whose name holds one of the parts."""
    return df.drop(*(c for c in df.columns if any(p in c for p in parts)))
