"""Tree walks over book records. The walks differ in what they visit and accept, and are kept apart.

They are filters over the rows of the single-pass shredding, so no walk parses a record again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.chunking import has_text
from quire.operators.nested import emit_tagged, table_of


def _stem(file: Column) -> Column:
    return F.replace(file, F.lit(".json"), F.lit(""))


def walk(book_json: DataFrame, kind: str) -> DataFrame:
    """(record_id, node_path, text) accepted by a walk; the root has the path ''.

    content: all nodes and the root's text, empty text dropped. lists: nodes under list-valued content only,
    root excluded. top: the root's direct entries only, no recursion.
    """
    tagged = emit_tagged(book_json, "node", "book")
    nodes = table_of(tagged, "node").where("text IS NOT NULL AND text <> ''")
    if kind == "lists":
        return nodes.where("NOT single").select("record_id", F.col("key").alias("node_path"), "text")
    if kind == "top":
        return nodes.where("depth = 1 AND NOT single").select("record_id", F.col("key").alias("node_path"), "text")
    root = table_of(tagged, "book").where("text IS NOT NULL AND text <> ''").select("record_id", F.lit("").alias("node_path"), "text")
    return root.unionByName(nodes.select("record_id", F.col("key").alias("node_path"), "text"))


def flatten_with_ids(book_json: DataFrame) -> DataFrame:
    """(record_id, base_id, source_file, node_path, inferred_type, text) of nodes with non-blank text, root included.

    An id is the file's stem and a two-digit, 1-based number for each level; a content that is an object adds none.
    """
    tagged = emit_tagged(book_json, "node", "book")
    nodes = table_of(tagged, "node", "file").select("record_id", "file", F.col("key").alias("node_path"), "id_suffix", "inferred_type", "text")
    root = table_of(tagged, "book", "file").select("record_id", "file", F.lit("").alias("node_path"), F.lit("").alias("id_suffix"), F.lit(None).cast("string").alias("inferred_type"), "text")
    rows = nodes.unionByName(root).where(has_text(F.col("text")))
    return rows.select("record_id", F.concat(_stem(F.col("file")), "id_suffix").alias("base_id"), F.col("file").alias("source_file"), "node_path", "inferred_type", "text")


def collection_chunks(book_json: DataFrame) -> DataFrame:
    """(record_id, chunk_id, inferred_type) for test sets: <file>_<book>_<chunk>; book 0 for a single book,
    else 1-based over all top-level entries; chunks count from 0 in a book, those with text only."""
    tagged = emit_tagged(book_json, "node", "book")
    book = table_of(tagged, "book").select("record_id", "source_file", F.coalesce("is_collection", F.lit(False)).alias("is_collection"))
    nodes = table_of(tagged, "node").select("record_id", "key", "depth", "inferred_type", F.coalesce(F.col("text") != "", F.lit(False)).alias("full"))
    rows = nodes.join(book, "record_id")
    parts = F.split("key", "/")
    number = F.when(F.col("is_collection"), parts[0].cast("long") + 1).otherwise(0)
    # in a collection the entries of a section are its chunks; a loose entry is a book of one chunk
    wanted = (~F.col("is_collection") & (F.col("depth") == 1)) | (F.col("is_collection") & (F.col("depth") == 2))
    chunk = F.when(F.col("is_collection"), parts[1].cast("long")).otherwise(parts[0].cast("long"))
    rows = rows.where(wanted & F.col("full"))
    return rows.select("record_id", F.concat_ws("_", "source_file", number.cast("string"), chunk.cast("string")).alias("chunk_id"), "inferred_type")
