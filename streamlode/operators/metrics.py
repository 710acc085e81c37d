"""Accuracy by chunk, running accuracy and sums over runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_chunk(predicted: DataFrame) -> DataFrame:
    """correct and total of each chunk; decoys (is_real false) do not count."""
    real = F.col("is_real") if "is_real" in predicted.columns else F.lit(True)
    hit = (F.col("pred") == F.col("label")) & real
    return predicted.groupBy("chunk_id").agg(F.sum(hit.cast("long")).alias("correct"), F.sum(real.cast("long")).alias("total"))


def accuracy(predicted: DataFrame) -> DataFrame:
    return by_chunk(predicted).agg(F.sum("correct").alias("correct"), F.sum("total").alias("total")).withColumn("accuracy", F.round(F.try_divide("correct", "total"), 6))


def running(predicted: DataFrame, span: int = 4096) -> DataFrame:
    """Accuracy over all chunks up to each one. Spans of chunks are summed first, so no task sees every chunk."""
    return accumulated(by_chunk(predicted), span)


def accumulated(chunks: DataFrame, span: int = 4096) -> DataFrame:
    """The same from chunk_id, correct and total."""
    chunks = chunks.withColumn("span", F.floor(F.col("chunk_id") / span))
    spans = chunks.groupBy("span").agg(F.sum("correct").alias("c"), F.sum("total").alias("t"))
    before = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("span", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t"))
    upto = Window.partitionBy("span").orderBy("chunk_id")
    rows = chunks.join(spans, "span").select("chunk_id", (F.sum("correct").over(upto) + F.col("c")).alias("correct"), (F.sum("total").over(upto) + F.col("t")).alias("total"))
    return rows.withColumn("accuracy", F.round(F.try_divide("correct", "total"), 6))


def over_runs(runs: DataFrame) -> DataFrame:
    """runs: accuracy, seconds. Sums, as the report gives them, and means."""
    return runs.agg(F.count(F.lit(1)).alias("runs"), F.round(F.sum("accuracy"), 6).alias("accuracy_sum"), F.round(F.avg("accuracy"), 6).alias("accuracy_mean"), F.round(F.sum("seconds"), 6).alias("seconds_sum"))
