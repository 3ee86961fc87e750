"""Publisher and metadata-key statistics of book records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.nested import emit_tagged, table_of


def publisher_frequency(book_json: DataFrame) -> DataFrame:
    """Records per publisher, each entry of a list counted, and the row '(missing)' of records without one."""
    tagged = emit_tagged(book_json)
    meta = table_of(tagged, "metadata").where("name = 'publisher' AND value IS NOT NULL AND value <> ''")
    books = table_of(tagged, "book").select("record_id")
    named = meta.groupBy(F.col("value").alias("publisher")).agg(F.count("*").alias("n"))
    missing = books.join(meta.select("record_id").distinct(), "record_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("(missing)").alias("publisher"), "n")
    return named.unionByName(missing)


def first_publisher(book_json: DataFrame, unknown: str = "__UNKNOWN_PUBLISHER__") -> DataFrame:
    """(record_id, publisher): the first entry of a list, a non-empty string, else the sentinel."""
    tagged = emit_tagged(book_json)
    meta = table_of(tagged, "metadata").where("name = 'publisher' AND position = 0 AND value <> ''").select("record_id", "value")
    return table_of(tagged, "book").select("record_id").join(meta, "record_id", "left").select("record_id", F.coalesce("value", F.lit(unknown)).alias("publisher"))


def key_frequency(book_json: DataFrame) -> DataFrame:
    """Records per metadata key, keys of empty values included, and the row '(none)' of records without metadata."""
    books = table_of(emit_tagged(book_json, "book"), "book").select("meta_keys")
    named = books.select(F.explode("meta_keys").alias("metadata_key")).groupBy("metadata_key").agg(F.count("*").alias("n"))
    none = books.where("meta_keys IS NULL").agg(F.count("*").alias("n")).select(F.lit("(none)").alias("metadata_key"), "n")
    return named.unionByName(none)
