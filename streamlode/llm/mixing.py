"""Mixing sources to target weights by systematic sampling.

Sources share the words of the mix by weight; no source is repeated more than ``most`` times, and what
it cannot give is shared again among the others. Within a source every document is expected
``target / source size`` times. A prefix sum of these expectations, shifted by one random offset a source,
crosses an integer once for each copy that is emitted. Documents are taken in order of length class, so that
short and long ones are hit evenly and the words taken come near the target, and within a class by a hash of their ids.
Texts that are long against the target are sampled first, by the same rule; what they leave of it is what the others are
expected to give, so that no single text decides how near a source comes.

The prefix sum has two levels: cells (source, length class, range of hashes) are counted and summed, and rows
are numbered within their cell, so a source that holds most rows is spread over many tasks. How many ranges there are
does not change the order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, positions, unit_hash

WEIGHTS = (1, 2, 3)
#: A text of a source's target divided by this, or in one length class with such, is long.
LONG = 200


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """sizes: __src, __null, __size (long) for each source. Adds __target, the words that the mix shall take.

    Weights go by code point order of the sources, null last. The sum over the sources is the sum of
    their sizes. Each round caps the sources above ``most`` times their size; the rest share what remains.
    """
    ranked = materialize(positions(sizes, F.col("__null"), F.col("__src")))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("position"), F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumn("__weight", w)
    total = ranked.agg(F.sum("__size")).first()[0] or 0
    capped, level = -1, 0.0
    while True:
        over = F.col("__weight") * F.lit(level) > F.lit(float(most)) * F.col("__size") if capped >= 0 else F.lit(False)
        now, fixed, free = ranked.agg(
            F.count(F.when(over, 1)), F.coalesce(F.sum(F.when(over, F.col("__size"))), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("__weight"))), F.lit(0))
        ).first()
        if now == capped or not free:
            break
        capped, level = now, (total - most * fixed) / free
    share = F.least(F.lit(float(most)) * F.col("__size"), F.col("__weight") * F.lit(level))
    return ranked.withColumn("__target", share.cast("double")).drop("position", "__weight")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "") -> DataFrame:
    """All rows of docs, plus size, source_size, target, copies and taken (size times copies).

    Null texts have size 0; a null source is a source of its own. Repeated rows are rows like others.
    Input columns named like the new ones are replaced. No rows give no rows. Reruns agree: the offsets
    are hashes of ``seed`` and the sources, and rows are ordered by length class and hashes of id and text.
    """
    docs = docs.drop("size", "source_size", "target", "copies", "taken")
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.withColumns({"size": size, "__src": F.coalesce(source_col, F.lit("")), "__null": F.col(source_col).isNull()})
    n = docs.count()
    buckets = max(32, -(-n // (1 << 18)))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = rows.withColumns({"__class": F.floor(F.log2(F.col("size") + 1.0) * 4).cast("int"), "__hash": unit_hash(key)})
    rows = rows.withColumn("__bucket", F.floor(F.col("__hash") * buckets / (1 << 32)).cast("int"))
    cell = ["__src", "__null", "__class", "__bucket"]
    cells = materialize(rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("__n"), F.sum("size").alias("__words")))
    sources = targets(cells.groupBy("__src", "__null").agg(F.sum("__words").alias("__size")), weights, most)
    sources = materialize(sources.withColumn("__from", F.floor(F.log2(F.col("__target") / LONG + 1.0) * 4).cast("int")))
    upto = lambda keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda keys, by: F.coalesce(F.sum("__n").over(upto(keys, by)), F.lit(0))
    about = cells.join(sources, ["__src", "__null"]).withColumn("__long", F.col("__class") >= F.col("__from"))
    classes = about.groupBy(*cell[:3], "__long").agg(F.sum("__n").alias("__n"))
    classes = classes.select(*cell[:3], before([*cell[:2], "__long"], "__class").alias("__base"))
    offset = unit_hash(F.concat(F.lit(seed), F.when(F.col("__null"), "null ").otherwise("source "), F.col("__src"))) / F.lit(4294967296.0)
    even = F.when(F.col("__size") == 0, F.lit(0.0)).otherwise(F.col("__target") / F.greatest(F.col("__size"), F.lit(1)))
    about = materialize(
        about.withColumn("__in_class", before(cell[:3], "__bucket"))
        .join(classes, cell[:3])
        .select(*cell, "__long", "__words", (F.col("__base") + F.col("__in_class")).alias("__before"), F.col("__size").alias("source_size"), F.col("__target").alias("target"), even.alias("__rate"))
    )
    crossed = lambda i: F.floor(offset + F.col("__rate") * i)
    place = F.col("__before") + F.col("__at")
    copies = F.least(crossed(place) - crossed(place - 1), F.lit(most)).cast("long")
    order = Window.partitionBy(*cell).orderBy("__hash", "size", "__id", "__text")
    number = lambda some, places: some.withColumn("__at", F.row_number().over(order)).join(places, cell)
    rows = rows.withColumns({"__id": F.col(id_col), "__text": F.xxhash64(text_col)})
    # a word takes two bytes with its space: most texts are left out before their words are counted again
    limit = F.pow(F.lit(2.0), F.col("__from") / 4) - 1.0
    long = docs.withColumns({"__src": F.coalesce(source_col, F.lit("")), "__null": F.col(source_col).isNull()}).join(sources, ["__src", "__null"])
    long = long.where(F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) >= 2 * limit - 2).withColumn("size", size)
    long = long.withColumns({"__class": F.floor(F.log2(F.col("size") + 1.0) * 4).cast("int"), "__hash": unit_hash(key), "__id": F.col(id_col), "__text": F.xxhash64(text_col)})
    long = long.withColumn("__bucket", F.floor(F.col("__hash") * buckets / (1 << 32)).cast("int")).where(F.col("__class") >= F.col("__from"))
    long = long.select(*cell, "__hash", "size", "__id", "__text")
    taken = number(long, about.where("__long").select(*cell, "__before", "__rate")).groupBy("__src", "__null").agg(F.sum(copies * F.col("size")).alias("__taken"))
    short = about.where("not __long").groupBy("__src", "__null", "target").agg(F.sum("__words").alias("__short"))
    rest = short.join(taken, ["__src", "__null"], "left").withColumn("__left", F.col("target") - F.coalesce("__taken", F.lit(0)))
    rest = rest.select("__src", "__null", F.when(F.col("__short") == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(float(most)), F.col("__left") / F.greatest(F.col("__short"), F.lit(1))))).alias("__rest"))
    places = materialize(about.join(rest, ["__src", "__null"], "left").withColumn("__rate", F.when(F.col("__long"), F.col("__rate")).otherwise(F.col("__rest"))).drop("__rest", "__long", "__words"))
    out = number(rows, places).withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select(*docs.columns, "size", "source_size", "target", "copies", "taken")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of docs as many times as it is taken, with the columns of docs."""
    found = mix(docs, **options)
    return found.select(*docs.columns, F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("__copy")).drop("__copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH sized AS (
  SELECT doc_id, text, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
rows AS (
  SELECT *, coalesce(source, '') AS src, source IS NULL AS nul, CAST(floor(log2(size + 1.0::DOUBLE) * 4) AS INT) AS class,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS hash FROM sized),
sources AS (
  SELECT src, nul, CAST(sum(size) AS BIGINT) AS s, (row_number() OVER (ORDER BY nul, src) - 1) % 3 + 1 AS w FROM rows GROUP BY src, nul),
levels AS (
  SELECT *, (SELECT sum(s) FROM sources) - 3 * coalesce(sum(s) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM sources WINDOW o AS (ORDER BY 3.0::DOUBLE * s / w, src, nul)),
level AS (
  SELECT max(rest::DOUBLE / free::DOUBLE) AS l FROM levels),
aimed AS (
  SELECT *, least(3.0::DOUBLE * s, w::DOUBLE * (SELECT l FROM level)) AS target,
    CAST('0x' || substr(md5((CASE WHEN nul THEN 'null ' ELSE 'source ' END) || src), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM sources),
placed AS (
  SELECT r.doc_id, r.size, r.src, r.nul, a.s, a.target, a.u, class >= floor(log2(a.target / 200 + 1.0::DOUBLE) * 4) AS long, CASE WHEN a.s = 0 THEN 0.0::DOUBLE ELSE a.target / a.s::DOUBLE END AS rate,
    row_number() OVER (PARTITION BY r.src, r.nul, class >= floor(log2(a.target / 200 + 1.0::DOUBLE) * 4) ORDER BY class, hash, size, doc_id) AS i
  FROM rows r JOIN aimed a ON r.src = a.src AND r.nul = a.nul),
rest AS (
  SELECT src, nul, any_value(target) - coalesce(sum(CAST(least(floor(u + rate * i) - floor(u + rate * (i - 1)), 3) AS BIGINT) * size) FILTER (long), 0)::DOUBLE AS words,
    coalesce(sum(size) FILTER (NOT long), 0)::DOUBLE AS short FROM placed GROUP BY src, nul),
rated AS (
  SELECT p.* EXCLUDE (rate), CASE WHEN long THEN rate WHEN short = 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(3.0::DOUBLE, words / short)) END AS rate
  FROM placed p JOIN rest ON p.src = rest.src AND p.nul = rest.nul)
SELECT doc_id, size, s AS source_size, target,
  CAST(least(floor(u + rate * i) - floor(u + rate * (i - 1)), 3) AS BIGINT) * size AS taken FROM rated
"""
