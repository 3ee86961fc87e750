"""Sinks: report files, tables by publisher, JSON arrays, one file per row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.plans.runtime import cut, numbered


def write_csv(df: DataFrame, path: str, sep: str = ",", single: bool = False) -> None:
    """CSV or TSV with header; a single file only for small reports."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def write_by_publisher(df: DataFrame, path: str, column: str = "publisher") -> None:
    """One directory per publisher, with characters unfit for paths replaced. Rows of one publisher come together, but
    the large ones are split over tasks by the adaptive execution."""
    safe = F.regexp_replace(F.coalesce(column, F.lit("unknown")), r"[<>:\"/\\|?*]", "_")
    rows = df.withColumn("publisher_dir", safe).hint("rebalance", "publisher_dir")
    rows.write.mode("overwrite").partitionBy("publisher_dir").option("header", True).csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_json_array(df: DataFrame, path: str, order: str | Sequence[str]) -> None:
    """Part files that are, one after the other in order of their names, one JSON array of the rows in a unique order."""
    rows = cut(numbered(df, order, "_n"), "rows")
    total = rows.count()
    if not total:
        df.sparkSession.createDataFrame([("[]",)], "value string").coalesce(1).write.mode("overwrite").text(path)
        return
    body = F.concat(F.when(F.col("_n") == 1, "[").otherwise(","), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), F.when(F.col("_n") == total, "]").otherwise(""))
    rows.repartitionByRange("_n").sortWithinPartitions("_n").select(body.alias("value")).write.mode("overwrite").text(path)


def write_text_report(df: DataFrame, path: str, *columns: str) -> None:
    """Formatted lines, tab-separated."""
    df.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in columns)).alias("value")).write.mode("overwrite").text(path)


def write_files(df: DataFrame, folder: str, name: str = "name", text: str = "text") -> None:
    """One file per row, written by the executors into a folder that all of them mount at the same place."""

    def write(rows) -> None:
        import os

        os.makedirs(folder, exist_ok=True)
        for r in rows:
            tmp = os.path.join(folder, f".{r[name]}.part")
            with open(tmp, "w", encoding="utf-8") as f:
                f.write(r[text] or "")
            os.replace(tmp, os.path.join(folder, r[name]))  # a task run again leaves whole files

    df.select(name, text).foreachPartition(write)


def write_file_folders(df: DataFrame, path: str, name: str = "name", text: str = "text") -> None:
    """One folder name=<name> per row with its text as the only file, on any file system that Spark writes to."""
    rows = df.select(F.col(name).alias("name"), F.coalesce(text, F.lit("")).alias("value"))
    rows.repartition("name").write.mode("overwrite").partitionBy("name").option("lineSep", "\n").text(path)


def rename_files(plan: DataFrame, folder: str, back: bool = False) -> int:
    """Files of a folder renamed by a plan of (src, dst), or back; the number of files renamed. A file that isn't there, or
    whose new name is taken, is passed over, so that a run can be made again. Only names are changed, on any file system;
    the plan is read row by row."""
    spark = plan.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs, done = path(folder).getFileSystem(spark._jsc.hadoopConfiguration()), 0
    for r in plan.select("src", "dst").toLocalIterator():
        old, new = (path(folder, n) for n in ((r["dst"], r["src"]) if back else (r["src"], r["dst"])))
        if fs.exists(old) and not fs.exists(new):
            done += bool(fs.rename(old, new))
    return done


def mapping_log(coverage: DataFrame) -> DataFrame:
    """One row with the JSON object {"handled": [...], "unhandled": [...]} of the tags of a coverage report, sorted."""
    names = [F.sort_array(F.collect_set(F.when(F.col("handled") == h, F.col("tag")))).alias(n) for h, n in ((True, "handled"), (False, "unhandled"))]
    return coverage.agg(*names).select(F.to_json(F.struct("handled", "unhandled")).alias("value"))


def long_counts(**tables: DataFrame) -> DataFrame:
    """(element, type, n): several frequency tables with a column `item` as one."""
    out = None
    for kind, df in tables.items():
        part = df.select(F.col("item").alias("element"), F.lit(kind).alias("type"), "n")
        out = part if out is None else out.unionByName(part)
    return out
