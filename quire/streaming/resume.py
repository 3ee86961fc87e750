"""Resumable classification as an incremental run: new chunk files are labelled once, in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quire.operators.classify import Model, pending, rule_stub, run_model
from quire.sources.readers import exists


def classify_available(spark: SparkSession, chunks_dir: str, schema: T.StructType, results_dir: str, checkpoint: str, model: Model = rule_stub, files_per_batch: int = 100) -> None:
    """Label all chunk files that haven't been read yet, appending to results_dir; then stop.

    The stream's checkpoint keeps what was read. A batch that is run again after a failure skips the ids
    that already have a result, so results hold each id once.
    """

    def one(batch: DataFrame, _: int) -> None:
        todo = batch
        if exists(batch.sparkSession, results_dir):  # of the results only the ids are read
            todo = pending(batch, batch.sparkSession.read.schema("id string").parquet(results_dir))
        run_model(todo, model).write.mode("append").parquet(results_dir)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(chunks_dir)
    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
