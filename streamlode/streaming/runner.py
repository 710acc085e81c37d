"""Structured Streaming runners for models that stay as they are; see ``state`` for those that rows move."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A path below ``spark.checkpoint.dir``, the folder that the driver and all executors share."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        raise ValueError("a stream needs a shared folder: give out or set spark.checkpoint.dir")
    return f"{shared.rstrip('/')}/{name}_{uuid.uuid4().hex}"


def running_counts(stream: DataFrame, predict, iter_size: int, spark: SparkSession, out: str | None = None) -> DataFrame:
    """chunk_id, correct and total over a stream of row_id, features, label; runs until the input is used up.

    Each micro-batch writes its own partial counts to a folder named by its number, so a batch that is run again
    replaces what it wrote; the result sums them. out: a shared folder, else one below ``spark.checkpoint.dir``.
    """
    out = out or fresh_folder(spark, "counts")
    found = predict(stream.withColumn("chunk_id", F.floor(F.col("row_id") / iter_size)))

    def step(batch: DataFrame, number: int) -> None:
        metrics.by_chunk(batch).write.mode("overwrite").parquet(f"{out}/counts/batch={number}")

    query = found.writeStream.foreachBatch(step).option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    parts = spark.read.schema("chunk_id long, correct long, total long").parquet(f"{out}/counts")
    return parts.groupBy("chunk_id").agg(F.sum("correct").alias("correct"), F.sum("total").alias("total"))


def running_accuracy(stream: DataFrame, predict, iter_size: int, spark: SparkSession, out: str | None = None) -> DataFrame:
    """Accuracy over all chunks of exactly iter_size rows up to each one; a short tail does not count."""
    return metrics.accumulated(running_counts(stream, predict, iter_size, spark, out).where(F.col("total") == iter_size))
