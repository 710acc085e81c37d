"""Streams that stop and go on: state of k-means in the store, chunks in order of arrival."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from streamlode.operators import bayes, kmeans
from streamlode.sources import observations as o
from streamlode.streaming import state

SCHEMA = "row_id long, features array<double>, label int"


def clusters(count):
    return [kmeans.Cluster(k, [float(3 * k), float(k % 2)], 2, [6.0 * k, 2.0 * (k % 2)], class_label=k % 3) for k in range(count)]


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(3)
    return [(i, draw.normal(size=2).tolist() if i % 3 else [float(i % 13), 1.0], int(i % 3)) for i in range(120)]


def folded(rows, model):
    fold = kmeans.Fold(model.clusters)
    return [(i, *fold.take(np.array(x))) for i, x, _ in rows]


def test_state_outlives_the_query(spark, rows, tmp_path):
    models = {"few": kmeans.KMeansModel(clusters(3)), "more": kmeans.KMeansModel(clusters(5))}
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in range(3):
        some = rows[40 * part : 40 * part + 40]
        spark.createDataFrame(some[::-1], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        # the query ends with each part; the next one finds its sums in the store
        state.sequential(spark.readStream.schema(SCHEMA).parquet(source), models, out).awaitTermination()
        got = state.predictions(spark, out).collect()
        for name, model in models.items():
            assert sorted((r.row_id, r.k, r.pred) for r in got if r.model == name) == folded(rows[: 40 * part + 40], model)
    again = state.sequential(spark.readStream.schema(SCHEMA).parquet(source), models, out)
    again.awaitTermination()
    assert state.predictions(spark, out).count() == 240


def test_models_side_by_side(spark, rows):
    models = {"few": kmeans.KMeansModel(clusters(3)), "more": kmeans.KMeansModel(clusters(5))}
    obs = o.chunked(spark.createDataFrame(rows, SCHEMA), 16)
    got = kmeans.predict_each(models, obs, order=(-F.col("row_id"),)).collect()
    for name, model in models.items():
        assert {(r.row_id, r.k, r.pred) for r in got if r.model == name} == set(folded(rows[::-1], model))


def test_chunks_in_order_of_arrival(spark, tmp_path):
    schema = "row_id long, features array<int>, label int"
    data = [(7 * i + 3, [i % 2, i % 5], i % 2) for i in range(50)]
    model = bayes.fit(spark.createDataFrame(data[:8], schema), o.DatasetSpec(num_features=3, num_classes=2))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    hits = [r.pred == r.label for r in model.predict(spark.createDataFrame(data, schema)).orderBy("row_id").collect()]
    for start, end in ((0, 11), (11, 12), (12, 50)):  # a chunk of 8 stays open between batches
        spark.createDataFrame(data[start:end][::-1], schema).coalesce(1).write.mode("append").parquet(source)
        state.arrived(spark.readStream.schema(schema).parquet(source), model.predict, 8, out, F.col("row_id")).awaitTermination()
        got = [tuple(r)[:3] for r in state.arrived_accuracy(spark, out, 8).orderBy("chunk_id").collect()]
        assert got == [(c, sum(hits[: 8 * c + 8]), 8 * c + 8) for c in range(end // 8)]


def test_no_arrivals(spark, tmp_path):
    assert state.arrived_accuracy(spark, str(tmp_path / "none"), 8).count() == 0


def test_open_chunks_wait_in_the_state(spark, rows, tmp_path):
    model = kmeans.KMeansModel(clusters(4))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    draw = lambda i: (i * 37) % 16
    ordered = [r for c in range(0, 112, 16) for r in sorted(rows[c : c + 16], key=lambda r: (draw(r[0]), r[0]))]
    want = folded(ordered, model)
    for start, end in ((0, 10), (10, 12), (12, 70), (70, 120)):  # chunks of 16; the last rows never fill one
        spark.createDataFrame(rows[start:end][::-1], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        state.sequential(stream, {"m": model}, out, chunk=16, draw=F.pmod(F.col("row_id") * 37, F.lit(16))).awaitTermination()
        got = state.predictions(spark, out).collect()
        assert sorted((r.row_id, r.k, r.pred) for r in got) == sorted(want[: end // 16 * 16])


def test_reset_and_spec():
    old = kmeans.Cluster(1, [2.0, 3.0], 4, [8.0, 12.0], {0: 4}, 0, 5.0)
    assert kmeans.reset([old]) == [kmeans.Cluster(1, [2.0, 3.0], 0, [0.0, 0.0])]
    for name in ("iter_size", "k", "fake_size"):
        with pytest.raises(ValueError):
            o.DatasetSpec(**{name: 0})
