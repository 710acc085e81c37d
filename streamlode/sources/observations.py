"""Reading instances: header CSV files, table adapters, chunks and the long form."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class DatasetSpec:
    """What the algorithms take as given about a dataset; num_features counts the label."""

    num_features: int = 5
    num_classes: int = 5
    num_values: int = 11
    iter_size: int = 128
    fake_size: int = 2
    k: int = 10
    em_iters: int = 10
    max_depth: int = 5
    seed: str = "7"

    def __post_init__(self):
        for name in ("num_features", "num_classes", "num_values", "iter_size", "fake_size", "k", "em_iters"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")


def to_int(text: Column) -> Column:
    """The integer that a text starts with, else 0 (decimals are cut off)."""
    return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?[0-9]+)", 1).try_cast("int"), F.lit(0))


def to_double(text: Column) -> Column:
    """The number that a text starts with, else 0."""
    return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1).try_cast("double"), F.lit(0.0))


def parse_row(line: Column, num_features: int, kind: str = "int") -> Column:
    """Up to num_features values of a comma-separated line; empty fields vanish and later ones move left."""
    packed = F.regexp_replace(F.regexp_replace(line, ",{2,}", ","), "^,|,$", "")
    fields, number = F.split(packed, ","), to_int if kind == "int" else to_double
    values = F.array(*(number(F.get(fields, F.lit(k))) for k in range(num_features)))  # by place: no lambda, so it stays in generated code
    return F.slice(values, 1, F.when(packed == "", 0).otherwise(F.least(F.size(fields), F.lit(num_features))))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """num_data, num_features, num_classes from the first line of a CSV file."""
    part = F.split("value", ",")
    return spark.read.text(path).limit(1).select(*(to_int(F.get(part, F.lit(k))).alias(n) for k, n in enumerate(("num_data", "num_features", "num_classes"))))


def cached_apart(table: DataFrame) -> DataFrame:
    """A cached table that no equal plan is answered from later, when the files may have changed."""
    return table.withColumn("run", F.lit(uuid.uuid4().hex)).persist().drop("run")


def read_csv(spark: SparkSession, path: str, num_features: int, kind: str = "int", most_broadcast: int = 500_000) -> DataFrame:
    """row_id (from 0, file by file in order of paths), features and label of the lines after each file's first. Short rows have a null label.

    Spark's text reader cuts the files; a line is numbered within its split, and a table of the splits' starts is joined to it, by a
    broadcast while there are at most ``most_broadcast`` splits. ``csv_source`` reads ranges of rows and streams.
    """
    about = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    lines = spark.read.text(path).select("value", *about, F.monotonically_increasing_id().alias("at"))
    splits = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    head = F.when(F.col("block") == 0, 1).otherwise(0)
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)  # one row for each split
    starts = splits.select("file", "block", (F.coalesce(F.sum(F.col("n") - head).over(before), F.lit(0)) - head).alias("start"), "first")
    starts = cached_apart(starts)
    rows = lines.join(F.broadcast(starts) if starts.count() <= most_broadcast else starts, ["file", "block"])
    rows = rows.where((F.col("block") > 0) | (F.col("at") > F.col("first")))
    rows = rows.select((F.col("start") + F.col("at") - F.col("first")).alias("row_id"), parse_row("value", num_features, kind).alias("v"))
    label = F.get("v", F.lit(num_features - 1)).cast("int")
    return rows.select("row_id", F.slice("v", 1, num_features - 1).alias("features"), label.alias("label"))


def obs_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    status = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    feats = [F.quarter("o_orderdate") - 1, status, F.floor(F.col("o_totalprice") / 50000), F.dayofmonth("o_orderdate") % 11]
    return o.select(F.col("o_orderkey").cast("long").alias("row_id"), F.array(*(f.cast("int") for f in feats)).alias("features"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("label"))


ORDERS_SQL = """obs AS (SELECT CAST(o_orderkey AS BIGINT) AS row_id, CAST(quarter(o_orderdate) - 1 AS INT) AS f0,
  CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS f1, CAST(floor(o_totalprice / 50000) AS INT) AS f2,
  CAST(day(o_orderdate) % 11 AS INT) AS f3, CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS label FROM orders)"""


def obs_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_rows(spark.read.parquet(f"{sf_dir}/events.parquet"))


def events_rows(e: DataFrame, *more: Column) -> DataFrame:
    feats = [F.col("user_id") % 11, F.floor(F.hour("ts") / 3), F.least(F.floor(F.col("value") / 50), F.lit(10)), F.get_json_object("props", "$.k").cast("long") % 11]
    kinds = ("click", "error", "purchase", "signup", "view")
    label = F.array_position(F.array(*map(F.lit, kinds)), F.col("event_type")).cast("int") - 1
    return e.select(F.col("event_id").cast("long").alias("row_id"), F.array(*(f.cast("int") for f in feats)).alias("features"), label.alias("label"), *more)


def timed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with their time, under ids with gaps."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events_rows(e, F.col("ts")).withColumn("row_id", F.col("row_id") * 7 + 3)


EVENTS_SQL = """obs AS (SELECT CAST(event_id AS BIGINT) AS row_id, CAST(user_id % 11 AS INT) AS f0, CAST(floor(hour(ts) / 3) AS INT) AS f1,
  CAST(least(floor(value / 50), 10) AS INT) AS f2, CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 11 AS INT) AS f3,
  list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 AS label FROM events)"""


def obs_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return v.select(F.col("vec_id").cast("long").alias("row_id"), F.col("embedding").cast("array<double>").alias("features"), F.col("label").cast("int").alias("label"))


VEC_SQL = "obs AS (SELECT CAST(vec_id AS BIGINT) AS row_id, CAST(embedding AS DOUBLE[]) AS x, CAST(label AS INT) AS label FROM embeddings)"


def chunked(obs: DataFrame, iter_size: int) -> DataFrame:
    """Add chunk_id: consecutive ids in runs of iter_size."""
    return obs.withColumn("chunk_id", F.floor(F.col("row_id") / iter_size))


def full_chunks(obs: DataFrame, iter_size: int, include_tail: bool = False, skip_train_chunk: bool = False) -> DataFrame:
    """Chunks that are evaluated: the last, short one is left out unless asked for."""
    n = obs.count()  # ids are dense: the count is read from the footers
    rows = chunked(obs, iter_size)
    if not include_tail:
        rows = rows.where(F.col("row_id") < n // iter_size * iter_size)
    return rows.where("chunk_id > 0") if skip_train_chunk else rows


def train_chunk(obs: DataFrame, iter_size: int) -> DataFrame:
    """Chunk 0. The filter on the id reaches the scan."""
    return obs.where((F.col("row_id") >= 0) & (F.col("row_id") < iter_size))


def chunk_at(obs: DataFrame, start: int, size: int) -> DataFrame:
    """Rows start to start + size, as offset and limit would give them."""
    return obs.where(F.col("row_id").between(start, start + size - 1))


def to_long(obs: DataFrame) -> DataFrame:
    """A row for each feature: row_id, f, v, label (and what else identifies the row)."""
    rest = [c for c in obs.columns if c != "features"]
    return obs.select(*rest, F.posexplode("features").alias("f", "v"))
