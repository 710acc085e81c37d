"""No single long text decides how near a source comes to its target."""

import random

from pyspark.sql import functions as F

from streamlode.llm import mixing


def test_sources_with_long_texts_come_near_their_targets(spark):
    rng = random.Random(6)
    rows = []
    for source in ("a", "b", "c", "d", None):
        sizes = [rng.randrange(1, 60) for _ in range(900)] + [rng.randrange(500, 3000) for _ in range(6)]
        rows += [(len(rows) + i, "w " * n, source) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    for seed in ("", "other"):
        found = mixing.mix(df, seed=seed)
        per = found.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("copies").alias("copies"))
        for r in per.collect():
            assert abs(r.taken / r.target - 1) < 0.01 and r.copies <= 3


def test_sources_of_long_texts_alone(spark):
    df = spark.createDataFrame([(1, "w " * 500, "a"), (2, "w " * 700, "a"), (3, "w", "b"), (4, None, "c")], "doc_id long, text string, source string")
    rows = {r.doc_id: r for r in mixing.mix(df).collect()}
    assert len(rows) == 4 and all(0 <= r.copies <= 3 for r in rows.values())
