"""Passes over texts hand Python workers small batches, whatever the session's own bounds are."""

import corpus_pipeline
import numpy as np
from streamlode.llm import packing, quality
from streamlode.llm.common import added


def bounded(real):
    def run(texts, *rest):
        if len(texts) > 2_000 or texts.nbytes > 5_000_000:
            raise ValueError(f"a batch of {len(texts)} rows, {texts.nbytes} bytes")
        return real(texts, *rest)

    return run


def many(spark):
    """5,000 short texts and 100 of 100,000 bytes in one partition."""
    return spark.range(0, 5_100, 1, 1).selectExpr("id as doc_id", "if(id < 5000, concat('word ', id), repeat('word text ', 10000)) as text", "'en' as lang", "'a' as source", "1 as n")


def test_quality_stage_scores_in_small_batches(spark, tmp_path, monkeypatch):
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(quality, "measured", bounded(quality.measured))
    monkeypatch.setattr(quality, "learn", lambda *_: quality.Model(bias=9.0))
    found = corpus_pipeline.keep_good(spark, many(spark), str(tmp_path))
    assert sorted(r.doc_id for r in found.select("doc_id").collect()) == list(range(5_100))


def test_packing_reads_texts_in_small_batches(spark, monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(packing, "term_counts", bounded(packing.term_counts))
    monkeypatch.setattr(packing, "routing_keys", bounded(packing.routing_keys))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    try:
        pieces = packing.pack(many(spark), public_tokenizers.path("byte_bpe_50k.json")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(p.doc_id for p in pieces if p.start == 0) == list(range(5_100))


def test_sums_over_all_rows_read_small_batches(spark):
    sums = added(many(spark).select("text"), lambda b: {0: np.array([b.num_rows, b.num_rows > 2_000, b.nbytes > 5_000_000])})
    assert sums[0].tolist() == [5_100, 0, 0]
