"""Exact deduplication by two-pass Bloom filtering, in DataFrame operations only.

Digests are computed once and written down. Pass 1 enters each row's hash into a register-blocked counting Bloom filter:
the hash picks one 64-bit block and three of its bits (a cell), and the cells that were hit twice set those bits; it moves
one number a row at most. Pass 2 tests every row against that filter. Only rows that hit it are possibly repeated, and
only those are shuffled by digest; the others pass straight through.

The filter has 16 bits a row up to ``max_blocks`` blocks of 8 bytes each, broadcast as arrays: 64 MB at most. Only repeated
texts set bits, 3 each; when these number over about 10**8, more rows are shuffled for nothing, but the result stays exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_RUN, materialize

#: Blocks in a row of the broadcast filter.
RUN = 1024


def normalised(text: Column) -> Column:
    """The text with each run of white space replaced by one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE_RUN, " ")


def digested(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with text_sha256."""
    return docs.withColumn("text_sha256", F.sha2(normalised(F.col(text_col)), 256))


def repeated_cells(rows: DataFrame, blocks: int) -> DataFrame:
    """__run, __bits: the filter's blocks, ``RUN`` to a row, with the bits of cells that rows (with __cell) hit twice."""
    cells = rows.groupBy("__cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    block, bit = F.shiftright("__cell", 18), lambda k: F.shiftright("__cell", 6 * k).bitwiseAND(F.lit(63)).cast("int")
    one = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), bit(k))
    set_ = cells.select(block.alias("block"), one(0).bitwiseOR(one(1)).bitwiseOR(one(2)).alias("bits"))
    every = rows.sparkSession.range(-(-blocks // RUN) * RUN).select(F.col("id").alias("block"), F.lit(0).cast("long").alias("bits"))
    bits = set_.unionByName(every).groupBy("block").agg(F.bit_or("bits").alias("bits"))
    runs = bits.groupBy(F.shiftright("block", 10).alias("__run")).agg(F.array_sort(F.collect_list(F.struct("block", "bits"))).alias("all"))
    return runs.select("__run", F.col("all.bits").alias("__bits"))


def resolve(rows: DataFrame, id_col: str = "doc_id", max_blocks: int = 1 << 23) -> DataFrame:
    """rows (written down, with text_sha256), plus keep_id, group_size and kept; see ``exact_dedup``."""
    names = rows.columns
    n = rows.count()
    blocks = max(1, min(max_blocks, n * 16 // 64))
    h = F.xxhash64("text_sha256")
    # 18 bits of the hash choose the bits, and the rest the block
    rows = rows.withColumn("__cell", F.pmod(F.shiftright(h, 18), F.lit(blocks)) * (1 << 18) + h.bitwiseAND(F.lit((1 << 18) - 1)))
    bit = lambda k: F.shiftright("__cell", 6 * k).bitwiseAND(F.lit(63)).cast("int")
    marked = rows.withColumn("__run", F.shiftright("__cell", 28)).join(F.broadcast(repeated_cells(rows, blocks)), "__run", "left")
    word = F.get("__bits", F.shiftright("__cell", 18).bitwiseAND(F.lit(RUN - 1)).cast("int"))
    hit = lambda k: F.call_function("shiftright", F.col("__word"), bit(k)).bitwiseAND(F.lit(1)) == 1
    tested = marked.withColumn("__word", word).withColumn("__hit", F.coalesce(hit(0) & hit(1) & hit(2), F.lit(False))).select(*names, "__hit")
    alone = tested.where(~F.col("__hit")).withColumns({"keep_id": F.col(id_col), "group_size": F.lit(1).cast("long")})
    suspects = tested.where("__hit")
    groups = suspects.groupBy("text_sha256").agg(F.min(id_col).alias("__keep"), F.count(F.lit(1)).alias("__size"))
    # Groups of over n/2000 rows number under 2000, so they can be broadcast; their rows do not meet in one task.
    hot = groups.where(F.col("__size") > max(1000, n // 2000)).select(
        "text_sha256", F.col("__keep").alias("__hot_keep"), F.col("__size").alias("__hot_size")
    )
    spread = suspects.join(F.broadcast(hot), "text_sha256", "left").withColumn(
        "__key", F.when(F.col("__hot_size").isNull(), F.col("text_sha256")).otherwise(F.concat(F.lit("hot "), F.xxhash64(id_col).cast("string")))
    )
    joined = spread.join(groups.withColumnRenamed("text_sha256", "__key"), "__key", "left").withColumns(
        {
            "keep_id": F.when(F.col("__hot_size").isNull(), F.col("__keep")).otherwise(F.col("__hot_keep")),
            "group_size": F.coalesce("__hot_size", "__size"),
        }
    )
    names = [*names, "keep_id", "group_size"]
    return alone.select(names).unionByName(joined.select(names)).withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_blocks: int = 1 << 23) -> DataFrame:
    """All rows and columns of docs, plus text_sha256, keep_id, group_size and kept.

    Null texts are empty; all empty texts are equal. A null id sorts after all ids: it is kept only if no
    row of its group has an id. Rows that share both text and id count in group_size and are all kept
    (``deduplicated`` leaves one of them). Input columns named like the new ones are replaced; no rows give no rows.
    The rows are written down with their digests, in the shared folder.
    """
    docs = docs.drop("text_sha256", "keep_id", "group_size", "kept")
    return resolve(materialize(digested(docs, text_col)), id_col, max_blocks)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one for each text, with the columns of docs."""
    found = exact_dedup(docs, id_col, text_col).where("kept")
    once = found.where("group_size = 1").select(docs.columns)
    # partial aggregation leaves one row of each repeated id and text before the shuffle
    return once.unionByName(found.where("group_size > 1").dropDuplicates(["text_sha256"]).select(docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return resolve(materialize(digested(docs).drop("text"))).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
