"""Shared helpers: durable intermediate tables, global positions, word hashing."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Python workers get small batches, since texts may be long: what a worker or the JVM's Arrow buffers took once, an executor keeps.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}
#: While a table is written, also drop the shuffle files behind it at the end.
WRITING = BATCHES | {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Local sessions without one get a temporary folder; others fail."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="streamlode-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextlib.contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """The session's settings for the actions within; afterwards they are as before."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    with settings(spark, WRITING):
        df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.written_to = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that no later action reads."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread_join(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, salt: Column) -> DataFrame:
    """rows with the other columns of groups (one row for each value of the long ``keys``), null where there is none.

    ``size`` bounds the rows of a key from above, and ``total`` their sum. Keys of more than total / 2000 rows number under
    2000 and are broadcast; their rows are dealt by ``salt``, so that none of them meet in one task.
    """
    values = [c for c in groups.columns if c not in keys]
    often = F.col(size) > max(1000, total // 2000)
    hot = groups.where(often).select(*keys, F.struct(*values).alias("__hot"))
    usual = groups.where(~often).select(*(F.col(k).alias(f"__{k}") for k in keys), F.struct(*values).alias("__usual"), F.lit(False).alias("__no"))
    marked = rows.join(F.broadcast(hot), keys, "left").withColumn("__is", F.col("__hot").isNotNull())
    first = F.when(F.col("__is"), salt).otherwise(F.col(keys[0]))
    on = (first == F.col(f"__{keys[0]}")) & (F.col("__is") == F.col("__no"))
    for k in keys[1:]:
        on &= F.col(k) == F.col(f"__{k}")
    joined = marked.join(usual, on, "left").withColumn("__found", F.coalesce("__hot", "__usual"))
    return joined.select(*rows.columns, *(F.col(f"__found.{c}").alias(c) for c in values))


def positions(df: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """Add the 0-based position in the total order of ``order``; ties must not matter.

    Range partitions are numbered in parallel; only one count per partition meets in one task.
    """
    parts = materialize(df.repartitionByRange(*order).withColumn("__pid", F.spark_partition_id()))
    ends = parts.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    before = ends.withColumn(
        "__before", F.coalesce(F.sum("__n").over(Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).select("__pid", "__before")
    local = F.row_number().over(Window.partitionBy("__pid").orderBy(*order))
    # one row per partition: the count of partitions bounds the broadcast
    return parts.join(F.broadcast(before), "__pid").withColumn(name, F.col("__before") + local - 1).drop("__pid", "__before")


def added(rows: DataFrame, arrays) -> dict[int, np.ndarray]:
    """The sums over all rows of the numbered arrays (of whole numbers, so that order does not matter) that ``arrays`` makes of each Arrow batch.

    A task adds up its own and sends one array for each number; those of one number meet in one task. The sums come to the driver.
    """
    import pyarrow as pa

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in arrays(b).items():
                total[k] = total[k] + v if k in total else v.astype(float)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))], ["k", "v"])

    def add(table):
        v = table.column("v").combine_chunks()
        total = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1).sum(axis=0)
        return pa.Table.from_pydict({"k": table.column("k")[:1], "v": pa.array([total], pa.list_(pa.float64()))})

    with settings(rows.sparkSession, BATCHES):
        found = rows.mapInArrow(run, "k int, v array<double>").groupBy("k").applyInArrow(add, "k int, v array<double>").toArrow()
    return {k: np.array(v.values.to_numpy(zero_copy_only=False)) for k, v in zip(found.column("k").to_pylist(), found.column("v"), strict=True)}


def unit_hash(col: Column) -> Column:
    """First 32 bits of the md5 of a string as a long."""
    return F.conv(F.substring(F.md5(col), 1, 8), 16, 10).cast("long")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (multiply and fold the high bits down)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: A value for each byte.
BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
BASE = 0x9E3779B97F4A7C13
INVERSE = pow(BASE, -1, 1 << 64)


@functools.cache
def powers(bits: int, base: int) -> np.ndarray:
    """The first 2**bits powers of an odd base, mod 2**64."""
    out = np.full(1 << bits, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def run_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each run from starts to ends (not empty) the sum of its values times powers of BASE, from the first power on: a rolling hash."""
    bits = max(16, len(values).bit_length())
    total = values * powers(bits, BASE)[: len(values)]
    np.cumsum(total, out=total)
    sums = total[ends - 1] - np.where(starts > 0, total[starts - 1], np.uint64(0))
    return sums * powers(bits, INVERSE)[starts]


def byte_values(lower: bool = False, separators: bytes = b" \t\n\v\f\r") -> np.ndarray:
    """The value of each byte in word hashes: 0 separates words; ``lower`` gives A-Z the values of a-z."""
    values = BYTES.copy()
    if lower:
        values[65:91] = values[97:123]
    values[list(separators)] = 0
    return values


@dataclass
class Words:
    """Words of consecutive texts: 64-bit hashes, first bytes and lengths in ``data``, and the first word of each text (and one past the last)."""

    data: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.first) - 1

    def of(self, k: int) -> np.ndarray:
        """Hashes of the words of text k."""
        return self.hashes[self.first[k] : self.first[k + 1]]

    def bytes_of(self, a: int, b: int) -> bytes:
        """Words a to b - 1, joined by one space."""
        data, starts, ends = self.data, self.starts[a:b].tolist(), (self.starts[a:b] + self.lengths[a:b]).tolist()
        return b" ".join([data[s:e].tobytes() for s, e in zip(starts, ends, strict=True)])


def find_words(data: np.ndarray, offsets: np.ndarray, values: np.ndarray, most: int = 1 << 20) -> Words:
    """Words of the texts that lie in ``data`` (bytes) between consecutive ``offsets``. A text of over ``most`` bytes is gone through in pieces."""
    if len(offsets) == 2 and len(data) > most:
        gaps = np.flatnonzero(values[data] == 0)
        cut = gaps[np.unique(np.searchsorted(gaps, np.arange(most, len(data), most))).clip(max=len(gaps) - 1)] if len(gaps) else gaps
        ends = np.unique(np.concatenate([cut, [len(data)]]))
        parts = [(a, find_words(data[a:b], np.array([0, b - a]), values, len(data))) for a, b in zip([0, *ends[:-1]], ends, strict=True) if a < b]
        join = lambda f: np.concatenate([f(a, w) for a, w in parts])
        hashes = join(lambda a, w: w.hashes)
        return Words(data, hashes, join(lambda a, w: w.starts + a), join(lambda a, w: w.lengths), np.array([0, len(hashes)]))
    valued = np.take(values, data, mode="clip")  # a byte is never out of range, and this mode does not look
    solid = valued != 0
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[heads] = solid[heads]
    ends[offsets[1:][offsets[:-1] < offsets[1:]] - 1] = solid[offsets[1:][offsets[:-1] < offsets[1:]] - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashes = run_sums(valued, starts, ends) if len(starts) else np.empty(0, np.uint64)
    lengths = ends - starts
    return Words(data, mix64(hashes + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), starts, lengths, np.searchsorted(starts, offsets))


def tokenized(texts, values: np.ndarray, most_bytes: int = 1 << 16) -> Iterator[tuple[int, Words]]:
    """The words of an Arrow array of strings (null: none) as (index of the first text, Words), ``most_bytes`` of text or one text at a time."""
    import pyarrow as pa

    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    k = 0
    while k < len(texts):
        end = max(int(np.searchsorted(offsets, offsets[k] + most_bytes, side="right")) - 1, k + 1)
        yield k, find_words(data[offsets[k] : offsets[end]], offsets[k : end + 1] - offsets[k], values)
        k = end


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive word hashes; empty if there are fewer words."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    m = len(words) - n + 1
    total = np.zeros(m, np.uint64)
    for i in range(n):
        total = (total + words[i : i + m]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return mix64(total)
