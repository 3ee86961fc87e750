"""Scans: book JSON, chunk files, gold maps, tables, listings."""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.plans.runtime import numbered

BOOKS_META = T.StructType([T.StructField(c, T.StringType()) for c in ("ID", "Title", "Publisher", "Series", "Date")])


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]+$", 0)


def read_book_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(path, source_file, body, valid) of the .json files of a directory, or of one file."""
    reader = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").option("recursiveFileLookup", str(recursive).lower())
    rows = reader.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))
    return rows.select("path", file_name(F.col("path")).alias("source_file"), "body", F.expr("coalesce(json_array_length(concat('[', body, ']')) = 1, false)").alias("valid"))


def split_rejects(books: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid books, rejects with a message)."""
    return books.where("valid").drop("valid"), books.where("NOT valid").select("path", F.lit("no valid JSON").alias("message"))


def require_object(books: DataFrame) -> DataFrame:
    """Fails at the first body that is no JSON object."""
    ok = F.expr("try_parse_json(body) IS NOT NULL AND schema_of_variant(try_parse_json(body)) LIKE 'OBJECT%'")
    return books.where(F.when(ok, True).otherwise(F.raise_error(F.concat(F.lit("no JSON object: "), "path")).cast("boolean")))


def slice_sorted(files: DataFrame, start: int, end: int, key: str = "path") -> DataFrame:
    """Files start to end - 1 in order of their paths, from 0."""
    return numbered(files, key, "_i").where((F.col("_i") > start) & (F.col("_i") <= end)).drop("_i")


#: What a table reader takes as missing by default.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def _typed(df: DataFrame) -> DataFrame:
    """String columns as numbers where all their values are; one pass over the table."""
    fits = [F.bool_and(F.col(f"`{c}`").isNull() | F.col(f"`{c}`").try_cast(kind).isNotNull()).alias(f"{k}{i}") for i, c in enumerate(df.columns) for k, kind in (("b", "bigint"), ("d", "double"))]
    got = df.agg(*fits).first()
    kinds = ["bigint" if got[f"b{i}"] else "double" if got[f"d{i}"] else "string" for i in range(len(df.columns))]
    return df.select(*(F.col(f"`{c}`").cast(kind).alias(c) for c, kind in zip(df.columns, kinds)))


def read_tsv(spark: SparkSession, path: str, schema: T.StructType | None = None, missing: Sequence[str] = ("",)) -> DataFrame:
    """Tab-separated with header, types by the schema or inferred. Only the empty string is null, so 'none' stays a
    value; with missing=MISSING all that a table reader takes as missing is."""
    reader = spark.read.option("sep", "\t").option("header", True).option("nullValue", "").option("mode", "PERMISSIVE")
    if tuple(missing) == ("",):
        return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    rows = (reader.schema(T.StructType([T.StructField(f.name, T.StringType()) for f in schema])) if schema else reader).csv(path)
    rows = rows.select(*(F.when(~F.col(f"`{c}`").isin(*missing), F.col(f"`{c}`")).alias(c) for c in rows.columns))
    return rows.select(*(F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema)) if schema else _typed(rows)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def input_path(spark: SparkSession, path: str | None, fallback: str) -> str:
    """The file or folder given, or the fallback folder where none is; a path that isn't there is an error."""
    chosen = path or fallback
    if not exists(spark, chosen):
        raise FileNotFoundError(chosen)
    return chosen


def setting(spark: SparkSession, name: str, default: str | None = None) -> str | None:
    """A setting from the session (`quire.` before its name), else from the environment, else the default."""
    found = spark.conf.get(f"quire.{name}", None)
    return found if found is not None else os.environ.get(name, default)


def read_chunk_files(spark: SparkSession, path: str) -> DataFrame:
    """(id, text) of JSON arrays of {id, text}, or single objects; of equal ids the last file's holds."""
    rows = spark.read.schema("id string, text string").option("multiLine", True).json(path).select("id", "text", F.col("_metadata.file_path").alias("p"))
    return rows.where("id IS NOT NULL").groupBy("id").agg(F.max_by("text", "p").alias("text"))


def merge_label_maps(maps: DataFrame, column: str = "body") -> DataFrame:
    """(id, label) of JSON arrays of {id: label} maps; later files, maps and keys win."""
    order = ["path"] if "path" in maps.columns else []
    rows = maps.select(*order, F.posexplode(F.from_json(column, "array<map<string,string>>")).alias("pos", "m"))
    rows = rows.select(*order, "pos", F.explode("m").alias("id", "label"))
    return rows.groupBy("id").agg(F.max_by("label", F.struct(*order, "pos")).alias("label"))


def gold_or_null(chunks: DataFrame, gold: DataFrame | None) -> DataFrame:
    """Gold labels, or all chunk ids with a null label where there are none."""
    return gold if gold is not None else chunks.select("id", F.lit(None).cast("string").alias("label"))


def list_epubs(spark: SparkSession, path: str) -> DataFrame:
    """(path, name) of files with the suffix .epub in any case; contents aren't read."""
    rows = spark.read.format("binaryFile").load(path).select("path")
    return rows.where(F.lower("path").endswith(".epub")).select("path", file_name(F.col("path")).alias("name"))


def collected_ids(names: DataFrame, column: str = "name") -> DataFrame:
    """Distinct ids: what stands before a folder name's first underscore."""
    return names.select(F.split_part(F.col(column), F.lit("_"), F.lit(1)).alias("id")).distinct()


def epub_plan(names: DataFrame, column: str = "name") -> DataFrame:
    """(src, dst): six-digit numbers in order of names, blanks as underscores; a plan, nothing is renamed."""
    rows = numbered(names.select(F.col(column).alias("src")).distinct(), "src")
    return rows.select("src", F.concat(F.format_string("%06d_", F.col("n")), F.replace("src", F.lit(" "), F.lit("_"))).alias("dst"))


#: Tags that lost their beginning in the template, and what they are.
TORN_TAGS = {"revisionDesc>": "<revisionDesc>", "/date>": "</date>"}


def load_template(text: str) -> str:
    """A TEI template with torn tags mended, stray ampersands escaped and the byte-order mark taken off."""
    text = text.lstrip("\ufeff")
    for torn, whole in TORN_TAGS.items():
        text = re.sub(rf"(?<![</]){re.escape(torn)}", whole, text)
    return re.sub(r"&(?!\w+;|#\d+;|#x[0-9a-fA-F]+;)", "&amp;", text)
