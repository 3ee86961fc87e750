"""Session, lineage cuts and size-checked joins."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A join side is broadcast only if its measured size stays under this many bytes.
BROADCAST_BYTES = 16 << 20


def get_session(cpus: str = "8", **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings its own."""
    builder = SparkSession.builder.master(f"local[{cpus}]")
    defaults = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; only where it is unset on a local master (tests) a local one is made and set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        folder = "file://" + tempfile.mkdtemp(prefix="quire-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quire/{name}-{uuid.uuid4().hex}"


_WRITTEN: list[tuple[SparkSession, str]] = []


def _forget_at_exit(spark: SparkSession, path: str) -> None:
    """Tables of this session are deleted when its program ends; results may read them until then."""
    if not _WRITTEN:
        atexit.register(_forget_all)
    _WRITTEN.append((spark, path))


def _forget_all() -> None:
    for spark, path in _WRITTEN:
        with contextlib.suppress(Exception):
            _delete(spark, path)
    _WRITTEN.clear()


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def cut(df: DataFrame, name: str = "table", partition_by: Sequence[str] = ()) -> DataFrame:
    """Write df into the shared folder and read it back: a lineage cut that survives lost executors."""
    path = new_path(df.sparkSession, name)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    _forget_at_exit(df.sparkSession, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quire_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Delete a table written by cut() that nothing reads any more."""
    path = getattr(df, "_quire_path", None)
    if path:
        _delete(df.sparkSession, path)


def cut_bytes(df: DataFrame) -> int:
    """Bytes on disk of a table written by cut()."""
    jvm = df.sparkSession._jvm
    target = jvm.org.apache.hadoop.fs.Path(df._quire_path)
    fs = target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    return int(fs.getContentSummary(target).getLength())


def join_checked(left: DataFrame, right_cut: DataFrame, keys: Sequence[str], how: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join with a table written by cut(): broadcast if its files are small, else a shuffled join that AQE may split at skew."""
    small = cut_bytes(right_cut) * 8 <= limit
    return left.join(F.broadcast(right_cut) if small else right_cut.hint("merge"), list(keys), how)


#: Bytes of files worth a task of their own where a scan has too few tasks.
SPREAD_BYTES = 512 << 10


def spread(df: DataFrame) -> DataFrame:
    """A scan with less than half as many tasks as cores (one file of one row group, say) spread over the cores.

    Only so small a scan is moved: at most half the cores' splits. A scan with enough splits is left as it is.
    """
    plan = df._jdf.queryExecution()
    size = int(plan.optimizedPlan().stats().sizeInBytes())
    tasks = min(df.sparkSession.sparkContext.defaultParallelism, -(-size // SPREAD_BYTES))
    return df.repartition(tasks) if tasks >= 2 * plan.toRdd().getNumPartitions() else df


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(os.path.join(folder, f"{name}.parquet")))


def table_reader(spark: SparkSession, folder: str) -> Callable[[str], DataFrame]:
    return lambda name: read_table(spark, folder, name)


def numbered(df: DataFrame, key: str | Sequence[str], name: str = "n") -> DataFrame:
    """Rows numbered from 1 in order of a unique key of one or more columns, without ordering them all in one task.

    The rows are ranged over tasks and written; a task's rows are numbered from the count of the rows before it.
    """
    spark, keys = df.sparkSession, [key] if isinstance(key, str) else list(key)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(tasks, *keys).withColumn("_p", F.spark_partition_id()), "ranged")
    order = Window.partitionBy(F.lit(0)).orderBy("_p")  # as many rows as tasks
    before = ranged.groupBy("_p").agg(F.count("*").alias("_c")).withColumn("_before", F.sum("_c").over(order) - F.col("_c")).select("_p", "_before")
    place = F.row_number().over(Window.partitionBy("_p").orderBy(*keys))
    return ranged.join(F.broadcast(before), "_p").withColumn(name, F.col("_before") + place).drop("_p", "_before")


def numbered_within(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "n") -> DataFrame:
    """Rows numbered from 1 within each group in a unique order; a group of any size is spread over tasks.

    Null group keys are a group of their own.
    """
    rows = cut(numbered(df, [*group, *order], "_n"), "numbered")
    first = cut(rows.groupBy(*group).agg((F.min("_n") - 1).alias("_first")), "first")
    small = cut_bytes(first) * 8 <= BROADCAST_BYTES
    first = first.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(group)), "_first")
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(group)]
    return rows.join(F.broadcast(first) if small else first, same).withColumn(name, F.col("_n") - F.col("_first")).drop("_n", "_first", *(f"_k{i}" for i in range(len(group))))
