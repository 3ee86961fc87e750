"""Word, token and markup-overhead statistics of chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import WINDOWS, byte_tokens
from quire.operators.shred import html_text


def word_count(text: Column) -> Column:
    """Runs of non-white characters, Unicode white space counted."""
    return F.when(text.isNull(), 0).otherwise(F.regexp_count(text, F.lit(r"(?U)\S+"))).cast("long")


def plain_approx(text: Column) -> Column:
    """Tags replaced by a blank, white space collapsed: the native stand-in for the parsed text."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^<>]*>", " "), r"(?U)\s+", " "))


def tag_count(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("<"), F.lit("")))).cast("long")


def windows_needed(tokens: Column, window: int) -> Column:
    return F.ceil(tokens / window).cast("long")


def diagnosis(tokens_markup: Column, ratio: Column, strategy: Column | None = None) -> Column:
    """Why a chunk is large: over 20000 tokens an unsplit novel, heavy markup (ratio over 3), or long text."""
    unsplit = strategy == "novel_no_separator" if strategy is not None else F.lit(False)
    return F.when(tokens_markup <= 20000, "not large").when(unsplit, "unsplit novel").when(ratio > 3, "heavy markup").otherwise("long text")


def token_stats(chunks: DataFrame, plain: Callable[[Column], Column] = plain_approx, tokens: Callable[[Column], Column] = byte_tokens) -> DataFrame:
    """One row per chunk with text: words, tokens of text and markup, overhead, ratio, tags, windows needed.

    plain and tokens are pluggable column functions, so a model's tokenizer can stand in for the bytes.
    """
    text = F.col("text")
    rows = chunks.where(text.isNotNull()).withColumn("plain", plain(text))
    rows = rows.select(
        "id", F.col("source_file").alias("filename"), F.when(F.col("inferred_type").isin("chapter", "novel"), "narrative").otherwise("meta").alias("unit_type"), "inferred_type",
        word_count(F.col("plain")).alias("words_plain"), tokens(F.col("plain")).alias("tokens_plain"), tokens(text).alias("tokens_markup"), tag_count(text).alias("tags_approx"),
    )
    rows = rows.withColumn("tokens_overhead", F.col("tokens_markup") - F.col("tokens_plain"))
    rows = rows.withColumn("ratio_markup", F.when(F.col("tokens_plain") == 0, 1.0).otherwise(F.round(F.col("tokens_markup") / F.col("tokens_plain"), 4)))
    return rows.withColumns({f"chunks_needed_{w}": windows_needed(F.col("tokens_markup"), w) for w in WINDOWS})


def by_book(stats: DataFrame) -> DataFrame:
    """Token sums per file for narrative, meta and all ('total'), with the overhead in percent; one grouping-sets plan."""
    sets = stats.groupingSets([["filename", "unit_type"], ["filename"]], "filename", "unit_type").agg(
        F.sum("tokens_plain").alias("tokens_plain"), F.sum("tokens_markup").alias("tokens_markup"), F.count("*").alias("n_chunks"), F.grouping("unit_type").alias("g")
    )
    percent = F.when(F.col("tokens_plain") > 0, (F.col("tokens_markup") - F.col("tokens_plain")) * 100.0 / F.col("tokens_plain")).otherwise(0.0)
    return sets.select("filename", F.when(F.col("g") == 1, "total").otherwise(F.col("unit_type")).alias("unit_type"), "tokens_plain", "tokens_markup", "n_chunks", F.round(percent, 4).alias("overhead_percent"))


def chunk_summary(stats: DataFrame, measures: tuple[str, ...] = ("words_plain", "tokens_plain", "tokens_markup")) -> DataFrame:
    """Mean, exact median, least and greatest of the measures over narrative chunks."""
    aggs = [f(F.col(m)).alias(f"{m}_{n}") for m in measures for n, f in (("mean", F.avg), ("median", F.median), ("min", F.min), ("max", F.max))]
    return stats.where("unit_type = 'narrative'").agg(*aggs)


def book_summary(stats: DataFrame) -> DataFrame:
    """Mean and median over books of their narrative sums; a book without narrative counts as 0."""
    sums = stats.groupBy("filename").agg(F.sum(F.when(F.col("unit_type") == "narrative", F.col("tokens_markup")).otherwise(0)).alias("s"))
    return sums.agg(F.count("*").alias("n_books"), F.avg("s").alias("mean_tokens"), F.median("s").alias("median_tokens"))


def largest(stats: DataFrame) -> DataFrame:
    """The narrative chunk with the most markup tokens, the least id among equals; one map-side aggregate."""
    best = F.min_by(F.struct("tokens_markup", "id"), F.struct(-F.col("tokens_markup"), "id")).alias("b")
    return stats.where("unit_type = 'narrative'").agg(best).where("b IS NOT NULL").select("b.tokens_markup", "b.id")


_TEXT = pa.schema([("id", pa.string()), ("plain_text", pa.string())])


def _visible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [html_text(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(texts, pa.string())], schema=_TEXT)


def visible_text(chunks: DataFrame) -> DataFrame:
    """(id, plain_text): the parsed visible text; null stays null."""
    return chunks.select(F.col("id").cast("string").alias("id"), "text").mapInArrow(_visible, "id string, plain_text string")


def overlong(chunks: DataFrame, most: int = 100_000) -> DataFrame:
    """Guard before a model run: 'no_text' for blank text, 'too_long' beyond `most` characters, else 'ok'."""
    flag = F.when(~F.coalesce(F.col("text").rlike(r"(?U)\S"), F.lit(False)), "no_text").when(F.length("text") > most, "too_long").otherwise("ok")
    return chunks.select("id", flag.alias("guard"))
