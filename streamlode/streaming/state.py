"""Streams with state: k-means that each row moves, in a state store, and chunks of an exact count of rows in order of arrival."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.utils import AnalysisException

from ..operators import metrics
from ..operators.kmeans import Fold, KMeansModel

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


ROW = "row_id long, label int, draw long, features array<double>"


class SequentialProcessor(StatefulProcessor):
    """Folds rows, in order, through a model's sums and counts, which the state store keeps.

    Without ``chunk`` the order is that of row_id, and every row is folded in the micro-batch that brings it. With it rows are
    cut into chunks of that many in order of arrival and folded chunk by chunk, by draw; the rows of a chunk that is still open
    wait in the state store too.
    """

    def __init__(self, models: dict[str, KMeansModel], frozen: bool = False, chunk: int | None = None):
        self.models, self.frozen, self.chunk = models, frozen, chunk

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("fold", "n array<double>, sums array<double>")
        self.waiting = handle.getListState("waiting", ROW)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        fold = Fold(self.models[key[0]].clusters)
        if self.state.exists():
            n, sums = self.state.get()
            fold.restore(np.array(n, float), np.array(sums, float))
        batch = pd.concat(rows).sort_values("row_id", kind="stable")[["row_id", "label", "draw", "features"]]  # bounded by the trigger
        if self.chunk:
            held = list(self.waiting.get()) if self.waiting.exists() else []  # fewer than a chunk
            batch = pd.concat([pd.DataFrame(held, columns=batch.columns), batch]) if held else batch
            full = len(batch) // self.chunk * self.chunk
            rest, batch = batch.iloc[full:], batch.iloc[:full].assign(at=np.arange(full) // self.chunk)
            self.waiting.clear()
            if len(rest):
                self.waiting.put([(int(i), int(y), int(d), [float(v) for v in x]) for i, y, d, x in rest.itertuples(index=False)])
            batch = batch.sort_values(["at", "draw", "row_id"], kind="stable")
        found = [fold.take(np.asarray(x, float), self.frozen) for x in batch["features"]]
        self.state.update((fold.n.tolist(), fold.sums.ravel().tolist()))
        yield pd.DataFrame({"model": key[0], "row_id": batch["row_id"].astype(np.int64), "label": batch["label"].astype(np.int32), "k": pd.Series([k for k, _ in found], index=batch.index, dtype=np.int32), "pred": pd.Series([p for _, p in found], index=batch.index, dtype=np.int32)})

    def close(self) -> None:
        pass


def sequential(stream: DataFrame, models: dict[str, KMeansModel], out: str, frozen: bool = False, chunk: int | None = None, draw: Column | None = None):
    """Start scoring a stream of row_id, features, label by models whose centroids each row moves; returns the query.

    Every model sees every row, and is a key of the state: models run side by side, the rows of one model in order. Rows are
    ordered by row_id within a micro-batch and must arrive in order across batches. chunk: rows are folded in chunks of that many,
    each in the order of ``draw`` (a whole number of the row), ties by row_id; a last chunk that never fills gives no predictions. A micro-batch of a model is
    held in memory, so bound it at the source (maxFilesPerTrigger, maxBytesPerTrigger). Labels are not null.
    Predictions (model, row_id, label, k, pred) go to Parquet files below ``out``/rows, progress and state to ``out``/progress: a
    query that is started again goes on where the last batch ended.
    """
    spark = stream.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        each = stream.select(F.explode(F.array(*map(F.lit, sorted(models)))).alias("model"), "row_id", "label", (F.lit(0) if draw is None else draw).cast("long").alias("draw"), F.col("features").cast("array<double>").alias("features"))
        scored = each.groupBy("model").transformWithStateInPandas(SequentialProcessor(models, frozen, chunk), "model string, row_id long, label int, k int, pred int", "append", "none")
        return scored.writeStream.format("parquet").outputMode("append").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, before)


def predictions(spark: SparkSession, out: str) -> DataFrame:
    """What ``sequential`` has written so far."""
    return spark.read.schema("model string, row_id long, label int, k int, pred int").parquet(f"{out}/rows")


def numbered(batch: DataFrame, start: int, path: str, *order: Column) -> DataFrame:
    """batch with pos, from ``start`` on in the given order (ties must not matter). Ranges of rows are written to path and numbered side by side.

    Only one count for each range meets in one task, and the table of their starts has one row for each range.
    """
    spark = batch.sparkSession
    batch.repartitionByRange(*order).withColumn("range", F.spark_partition_id()).write.mode("overwrite").parquet(path)
    rows = spark.read.schema(T.StructType([*batch.schema.fields, T.StructField("range", T.IntegerType())])).parquet(path)
    sizes = rows.groupBy("range").agg(F.count(F.lit(1)).alias("size"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("range", (F.coalesce(F.sum("size").over(earlier), F.lit(0)) + start).alias("first"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return rows.withColumn("place", place).join(F.broadcast(starts), "range").withColumn("pos", F.col("first") + F.col("place") - 1).drop("range", "first", "place")


def arrived(stream: DataFrame, predict, iter_size: int, out: str, *order: Column):
    """Start counting hits over chunks of exactly iter_size rows in order of arrival; returns the query.

    Ids play no part: rows are numbered as they come, micro-batch after micro-batch and in the given order within one. How
    many rows came before, and with it how many the chunk still open holds, is written with each batch's counts, below
    ``out``, under the batch's number; a batch that is run again finds the state of the one before and replaces its own.
    """
    spark = stream.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        start = 0
        if number:
            start = spark.read.schema("total long").parquet(f"{out}/state/batch={number - 1}").first()["total"]
        rows = numbered(batch, start, f"{out}/arrived/batch={number}", *order)
        n = rows.count()
        chunks = predict(rows.withColumn("chunk_id", F.floor(F.col("pos") / iter_size)))
        metrics.by_chunk(chunks).write.mode("overwrite").parquet(f"{out}/counts/batch={number}")
        spark.createDataFrame([(start + n,)], "total long").coalesce(1).write.mode("overwrite").parquet(f"{out}/state/batch={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start()


def arrived_accuracy(spark: SparkSession, out: str, iter_size: int) -> DataFrame:
    """Accuracy over all full chunks up to each one, of what ``arrived`` has counted so far."""
    try:
        parts = spark.read.schema("chunk_id long, correct long, total long").parquet(f"{out}/counts")
    except AnalysisException:  # no batch yet
        parts = spark.createDataFrame([], "chunk_id long, correct long, total long")
    chunks = parts.groupBy("chunk_id").agg(F.sum("correct").alias("correct"), F.sum("total").alias("total"))
    return metrics.accumulated(chunks.where(F.col("total") == iter_size))
