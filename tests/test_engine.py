"""Hand-computed cases, variants that must agree, and queries against their SQL."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from streamlode.functions import scalars as s
from streamlode.operators import bayes, decoys, kmeans, metrics, tree
from streamlode.plans import catalogue
from streamlode.plans.experiment import Experiment, append_blob, append_result, grid
from streamlode.sources import observations as o

MINI = [(0, 0, 0), (0, 1, 0), (1, 0, 1), (1, 1, 1), (0, 0, 0), (1, 0, 1), (0, 1, 0), (1, 1, 1)]
SPEC = o.DatasetSpec(num_features=3, num_classes=2, iter_size=4, k=2)
DATA = "/root/testdata/sf0.001"


@pytest.fixture
def mini(spark):
    return spark.createDataFrame([(i, [a, b], c) for i, (a, b, c) in enumerate(MINI)], "row_id long, features array<int>, label int")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_rows_are_parsed_like_c(spark):
    assert one(spark, o.parse_row(F.lit("1,,2,3abc,x"), 4)) == [1, 2, 3, 0]
    assert one(spark, o.parse_row(F.lit(",,1,,,2,"), 4)) == [1, 2] and one(spark, o.parse_row(F.lit(""), 2)) == [] == one(spark, o.parse_row(F.lit(",,"), 2))
    assert one(spark, o.parse_row(F.lit("3.9,-2, 7,9,5"), 4)) == [3, -2, 7, 9]
    assert one(spark, o.parse_row(F.lit("3.9,abc,1e2"), 3, "double")) == [3.9, 0.0, 100.0]


def test_csv_file(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_text("3,3,2\n" + "\n".join(",".join(map(str, r)) for r in MINI[:3]) + "\n")
    assert o.read_metadata(spark, str(path)).first() == (3, 3, 2)
    rows = o.read_csv(spark, str(path), 3).orderBy("row_id").collect()
    assert [(r.row_id, r.features, r.label) for r in rows] == [(0, [0, 0], 0), (1, [0, 1], 0), (2, [1, 0], 1)]


def test_scalars(spark):
    assert one(spark, s.squared_distance(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(3.0), F.lit(4.0)))) == 25
    assert one(spark, s.checksum(F.unhex(F.lit("0E" * 100)))) == -179901
    assert one(spark, s.checksum(F.unhex(F.lit("010002")))) == -(1 + 2) - 1
    assert one(spark, s.decrypt(s.encrypt(F.lit("x").cast("binary"), "0123456789abcdef"), "0123456789abcdef").cast("string")) == "x"
    assert one(spark, s.uniform_int(F.lit(9), F.lit(0))) == 0 and one(spark, s.uniform_double(F.lit(9), F.lit(0.00001))) == 0


def test_entropy_and_gain(spark):
    rows = spark.createDataFrame([("a", [v], y) for v, y in ((0, 0), (0, 0), (1, 1), (1, 1))], "node_id string, features array<int>, label int")
    assert tree.entropies(rows).first()["entropy"] == pytest.approx(0.693147, abs=1e-6)
    assert tree.best_splits(rows).first() == ("a", 0, 0.693147181)
    assert tree.entropies(rows.where("label = 0")).first()["entropy"] == 0


def test_mini_tree(spark, mini):
    model = Experiment(mini, SPEC, "tree").fit()
    root = model.nodes[""]
    assert (root.split_attr, model.nodes["/0"].class_label, model.nodes["/1"].class_label, model.nodes["/2"].class_label) == (0, 0, 1, -1)
    for variant in ("naive", "oblivious", "randomized"):
        e = Experiment(mini, SPEC, "tree", variant)
        assert [r["accuracy"] for r in e.evaluate(e.fit()).orderBy("chunk_id").collect()] == [1.0, 1.0]
    e = Experiment(mini, SPEC, "tree", "oblivious", "literal")
    assert [r["accuracy"] for r in e.evaluate(e.fit()).orderBy("chunk_id").collect()] == [0.0, 0.0]


def test_exhausted_features_leave_no_label(spark):
    rows = spark.createDataFrame([(i, [v], v) for i, v in enumerate((0, 0, 1, 1))], "row_id long, features array<int>, label int")
    spec = o.DatasetSpec(num_features=2, num_classes=2, iter_size=4)
    assert tree.fit(rows, spec).nodes["/0"].class_label == -1
    assert tree.fit(rows, spec, label_exhausted="majority").nodes["/1"].class_label == 1


def test_mini_bayes(spark, mini):
    for variant in ("naive", "oblivious", "randomized"):
        e = Experiment(mini, SPEC, "bayes", variant)
        assert [r["accuracy"] for r in e.evaluate(e.fit()).orderBy("chunk_id").collect()] == [1.0, 1.0]
    e = Experiment(mini, SPEC, "bayes", semantics="literal")
    assert [r["accuracy"] for r in e.evaluate(e.fit()).orderBy("chunk_id").collect()] == [0.5, 0.5]
    unseen = spark.createDataFrame([(0, [9, 9], 1)], "row_id long, features array<int>, label int")
    assert bayes.fit(mini, SPEC).predict(unseen).first()["pred"] == 0


def test_majority_tie_and_running_accuracy(spark):
    rows = spark.createDataFrame([("a", y) for y in (0, 0, 0, 1, 1, 1, 2)], "node_id string, label int")
    assert tree.entropies(rows).first()["majority"] == 0
    hits = [(c, 1 if i < k else 0, 1) for c, k in enumerate((8, 4, 12)) for i in range(16)]
    df = spark.createDataFrame(hits, "chunk_id long, pred int, label int")
    for span in (1, 2, 4096):
        assert [r["accuracy"] for r in metrics.running(df, span).orderBy("chunk_id").collect()] == [0.5, 0.375, 0.5]


def test_tail_is_dropped(spark):
    rows = spark.range(100).select(F.col("id").alias("row_id"), F.array(F.lit(0)).alias("features"), F.lit(0).alias("label"))
    assert o.full_chunks(rows, 16).agg(F.count_distinct("chunk_id"), F.count("*")).first() == (6, 96)
    assert o.full_chunks(rows, 16, include_tail=True).count() == 100
    assert o.full_chunks(rows, 16, skip_train_chunk=True).count() == 80


def test_kmeans(spark):
    pts = [(i, [float(i % 2) * 10 + i / 100, 0.0], i % 2) for i in range(16)]
    obs = spark.createDataFrame(pts, "row_id long, features array<double>, label int")
    spec = o.DatasetSpec(num_features=3, num_classes=2, iter_size=8, k=2)
    for variant in ("naive", "oblivious", "randomized"):
        e = Experiment(obs, spec, "kmeans", variant)
        model = e.fit()
        assert [r["accuracy"] for r in e.evaluate(model).orderBy("chunk_id").collect()] == [1.0, 1.0]
    seq = {r.row_id: r.pred for r in e.predict(model, sequential=True).collect()}
    fold = kmeans.Fold(model.clusters)
    assert seq == {i: fold.take(__import__("numpy").array(x))[1] for i, x, _ in pts}
    with pytest.raises(ValueError):
        kmeans.fit(obs.limit(1), spec)


def test_centroid_fold_and_ties(spark):
    import numpy as np

    state = kmeans.Fold([kmeans.Cluster(1, [1.0, 1.0], 2, [2.0, 2.0], class_label=3), kmeans.Cluster(4, [9.0, 15.0], 1, [9.0, 15.0], class_label=5)])
    assert state.take(np.array([5.0, 8.0])) == (1, 3)
    assert state.centroid[0].tolist() == [7 / 3, 10 / 3] and state.n[0] == 3
    near = kmeans.nearest([(4, [0.0]), (1, [2.0])], F.array(F.lit(1.0)))
    assert one(spark, near)["k"] == 1


def test_decoys(spark, mini):
    rows = decoys.augment(o.chunked(mini, 4), SPEC)
    assert rows.count() == 16 and rows.where("is_real").count() == 8 and rows.where("row_id < 0 and not is_real").count() == 8
    assert decoys.shuffled(o.chunked(mini, 4), SPEC).groupBy("chunk_id").agg(F.sort_array(F.collect_list("pos")).alias("p")).select("p").distinct().first()["p"] == [0, 1, 2, 3]


def test_sinks_and_grid(spark, mini, tmp_path):
    record = Experiment(mini, SPEC, "bayes").run(1)[0]
    append_result(spark, str(tmp_path / "out"), record)
    append_blob(spark, str(tmp_path / "blob"), b"\x01x")
    assert spark.read.text(str(tmp_path / "out")).first()["value"].startswith("k=2\tf=2\ti=4\tTime=")
    assert next((tmp_path / "blob").glob("part-*")).read_bytes() == b"\x01x\n"
    assert len(grid("kmeans", SPEC)) == 60 and len(grid("tree", SPEC)) == 12


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the tables")
@pytest.mark.parametrize("name", ["nb_predict", "info_gain", "km_label", "decoy_augment_int", "stream_nb_accuracy", "csv_parse_double", "dt_predict", "nb_obliv_scan", "stream_nb_running", "km_predict_sequential", "dt_decoy_walk", "dt_obliv_walk"])
def test_queries_match_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    got = catalogue.QUERIES[name](spark, DATA).toPandas()
    want = con.execute(catalogue.SQL[name]).df()
    cols = sorted(want.columns)
    key = lambda d: sorted(map(tuple, d[cols].astype(object).where(d[cols].notna(), None).values.tolist()), key=str)
    assert sorted(got.columns) == cols and [tuple(map(str, r)) for r in key(got)] == [tuple(map(str, r)) for r in key(want)]


def test_streamed_kmeans_equals_batch(spark):
    if not Path(DATA).exists():
        pytest.skip("needs the tables")
    batch = {r.row_id: r.pred for r in catalogue.km_predict_sequential(spark, DATA).collect()}
    stream = {r.row_id: r.pred for r in catalogue.stream_km_sequential(spark, DATA).collect()}
    assert batch.items() <= stream.items()
