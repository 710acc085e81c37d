"""Document fingerprints by content-defined chunking.

A gear hash rolls over the UTF-8 bytes of a text; a chunk ends where its top bits are zero. Chunking is
normalised: below the usual size more bits must be zero, above it fewer, between a least and a largest
size. An edit thus changes the chunks around it only. A fingerprint is the set of chunk digests with the
bytes that each covers; containment is the weight two sets share over the lighter set's weight.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64

LEAST, USUAL, MOST, STRICT_BITS, LOOSE_BITS = 16, 48, 192, 7, 5
GEAR = (mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def gear_hashes(data: bytes) -> np.ndarray:
    """At each byte the sum of the last 32 bytes' gear values, each shifted by its distance, mod 2**32."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for width in (1, 2, 4, 8, 16):
        older = np.zeros_like(h)
        older[width:] = h[:-width]
        h = h + (older << np.uint32(width))
    return h


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of data."""
    if len(data) <= LEAST:
        return [len(data)] if data else []
    h = gear_hashes(data)
    loose = np.flatnonzero(h >> np.uint32(32 - LOOSE_BITS) == 0)
    strict = loose[h[loose] >> np.uint32(32 - STRICT_BITS) == 0].tolist()
    loose, out, start, n = loose.tolist(), [], 0, len(data)
    while n - start > LEAST:
        k = bisect_left(strict, start + LEAST - 1)
        if k < len(strict) and strict[k] < start + USUAL - 1:
            end = strict[k] + 1
        else:
            k = bisect_left(loose, start + USUAL - 1)
            end = min(loose[k] + 1 if k < len(loose) else n, start + MOST, n)
        out.append(end)
        start = end
    if start < n:
        out.append(n)
    return out


def fingerprint(text: str) -> dict[int, int]:
    """Bytes covered by each chunk digest of a text."""
    import xxhash

    data, start, out = text.encode(), 0, {}
    for end in cuts(data):
        digest = xxhash.xxh3_64_intdigest(data[start:end])
        out[digest] = out.get(digest, 0) + end - start
        start = end
    return out


def written(found: dict[int, int]) -> str:
    """digest:bytes in hexadecimal, by digest; empty for an empty text."""
    return ",".join(f"{d:016x}:{w:x}" for d, w in sorted(found.items()))


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """Weight shared by two fingerprints over the lighter one's; two empty ones are alike, one empty one is like no other."""
    if not a or not b:
        return float(a == b)
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    shared = sum(min(w, large[d]) for d, w in small.items() if d in large)
    return shared / min(sum(a.values()), sum(b.values()))


def edited(text: str, following: str) -> str:
    """The last quarter of a text's characters replaced by as many from the start of the next."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame, rows_a_block: int = 1000, most_blocks: int = 50_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row (see OUT) for each row of docs, which are compared with the next by id (after the last: the first).

    Null texts are empty. Null ids come first; repeated rows follow each other, in the order of a hash of
    their texts. Other columns are left out; no rows give no rows, and a lone row is its own next.

    Documents are cut into blocks by id. The cut points come from a hash sample of about 50 ids a block; only
    these and the first id of each block reach the driver. A block's first document also goes to the block before.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = docs.count()
    blocks = max(1, min(most_blocks, n // rows_a_block))
    every = max(1, n // (50 * blocks))
    sample = np.sort(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select(F.coalesce("doc_id", F.lit(-(2**63))).alias("k")).toPandas()["k"].to_numpy(np.int64))
    bounds = np.unique(sample[(np.arange(1, blocks) * len(sample)) // blocks]) if len(sample) else np.empty(0, np.int64)

    @F.pandas_udf("long")
    def block_of(ids):
        return ids.fillna(-(2**63)).astype("int64").map(lambda x: int(np.searchsorted(bounds, x, side="right")))

    key = F.coalesce("doc_id", F.lit(-(2**63)))
    heads = docs.select(block_of(key).alias("block"), key.alias("key")).groupBy("block").agg(F.min("key").alias("head")).toPandas().sort_values("block")
    before = dict(zip(heads["head"], np.roll(heads["block"].to_numpy(), 1), strict=True))

    @F.pandas_udf("array<long>")
    def places(ids):
        """The document's block, and below zero the block that it follows, if it leads one."""
        own = np.searchsorted(bounds, ids.to_numpy(np.int64), side="right")
        import pandas as pd

        return pd.Series([[int(b), -1 - int(before[i])] if i in before else [int(b)] for i, b in zip(ids, own, strict=True)], dtype=object)

    placed = docs.withColumn("place", F.explode(places(key)))
    placed = placed.select("doc_id", "text", F.when(F.col("place") < 0, -1 - F.col("place")).otherwise(F.col("place")).alias("block"), (F.col("place") < 0).alias("copy"))
    # as many partitions as blocks, but no fewer than the session's
    count = max(blocks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = placed.repartition(count, "block").sortWithinPartitions("block", "copy", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))

    def run(batches) -> Iterator:
        import pyarrow as pa

        names = [c.split()[0] for c in OUT.split(", ")]
        types = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[c.split()[1]] for c in OUT.split(", ")]
        last, out, size = None, [], 0  # last: block, id, text, fingerprint

        def frame():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

        for batch in batches:
            for at in range(0, len(batch), 100):
                for i, text, block, copy in zip(*(c.to_pylist() for c in batch.slice(at, 100).columns), strict=True):
                    if last is None and copy:
                        continue
                    print_ = fingerprint(text)
                    if last is not None and last[0] == block:
                        new = edited(last[2], text)
                        other = fingerprint(new)
                        out.append((last[1], len(last[2]), hashlib.sha256(new.encode()).hexdigest(), written(last[3]), written(other), containment(last[3], other), containment(last[3], print_)))
                        size += len(last[2])
                    last = None if copy else (block, i, text, print_)
                    if size > 2_000_000:
                        yield frame()
                        out, size = [], 0
        if out:
            yield frame()

    return ordered.select("doc_id", "text", "block", "copy").mapInArrow(run, OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
