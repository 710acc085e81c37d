"""Models, counts and ranges of the pipeline come from all rows."""

import numpy as np
from pyspark.sql import functions as F

from streamlode.llm import packing, quality

from test_operators import labelled


def test_quality_is_learned_from_all_labelled_rows(spark, monkeypatch):
    docs, labels = labelled(spark, ["!!!!!", "|", "|"], 200)
    copies = spark.range(150).select("id")
    many = docs.where("text is not null and doc_id < 9000").crossJoin(copies).selectExpr("doc_id + id * 10000 as doc_id", "substring(text, 1, 20) as text")
    known = labels.crossJoin(copies).selectExpr("doc_id + id * 10000 as doc_id", "quality")
    seen = []
    monkeypatch.setattr(quality, "fitted", lambda rows: (seen.append(rows.count()), quality.Model())[1], raising=False)
    quality.accepted(many, known)
    wanted = many.join(known, "doc_id").where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2).count()
    assert wanted > 20_000 and seen == [wanted]


def test_packing_counts_terms_and_cuts_ranges_on_all_rows(spark, monkeypatch):
    counted, real = [], getattr(packing, "added", None)
    monkeypatch.setattr(packing, "added", lambda *args: counted.append(real(*args)) or counted[-1], raising=False)
    df = spark.createDataFrame([(i, f"a{i % 3} b{i % 40} c{i}") for i in range(7_000)], "doc_id long, text string")
    sizes = [r["n"] for r in packing.routed(df).withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 7_000 and max(sizes) - min(sizes) <= 2
    n = np.concatenate([counted[0][k] for k in sorted(counted[0])])
    assert n.sum() == 3 * 7_000 and [x // 10 for x in sorted(n)[-3:]] == [233, 233, 233]
