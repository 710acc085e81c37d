"""Saved models, the program's grid, bounds of EM, literal arithmetic and draws."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from streamlode import __main__ as program
from streamlode.functions import scalars as s
from streamlode.operators import bayes, decoys, kmeans, tree
from streamlode.plans import models
from streamlode.plans.experiment import Experiment, grid, recorded, run_grid, runnable
from streamlode.sources import observations as o

SPEC = o.DatasetSpec(num_features=3, num_classes=2, iter_size=8, k=2, num_values=4)


@pytest.fixture(scope="module")
def ints(spark):
    return spark.createDataFrame([(i, [i % 2, (i // 3) % 4], int(i % 5 < 2)) for i in range(64)], "row_id long, features array<int>, label int")


@pytest.fixture(scope="module")
def points(spark):
    draw = np.random.default_rng(5)
    rows = [(i, (draw.normal(size=2) + 9 * (i % 4)).tolist(), i % 4) for i in range(160)]
    return spark.createDataFrame(rows, "row_id long, features array<double>, label int")


def predictions(model, rows):
    return sorted((r.row_id, r.pred) for r in model.predict(rows).collect())


def test_saved_models_predict_the_same_in_another_session(spark, ints, points, tmp_path):
    fitted = {"tree": (tree.fit(ints, SPEC), ints), "bayes": (bayes.fit(ints, SPEC), ints), "table": (bayes.fit_table(ints, SPEC), ints), "clusters": (kmeans.fit(points, SPEC), points)}
    for name, (model, rows) in fitted.items():
        path, other = str(tmp_path / name), spark.newSession()
        with pytest.raises(ValueError):
            models.load(spark, path, SPEC)
        assert models.save(model, SPEC, path, spark) == 1
        loaded = models.load(other, path, SPEC)
        assert predictions(loaded, other.createDataFrame(rows.collect(), rows.schema)) == predictions(model, rows)
        with pytest.raises(ValueError):
            models.load(other, path, o.DatasetSpec(num_features=9, num_classes=2, k=2, num_values=4))
        assert models.save(model, SPEC, path, spark) == 2
        assert sorted(r.version for r in models.versions(other, path).collect()) == [1, 2]
        with pytest.raises(ValueError):
            models.load(other, path, SPEC, version=3)


def test_tree_grows_on_a_whole_table(spark, ints):
    model = tree.fit(ints.unionByName(ints.withColumn("label", F.lit(None).cast("int"))), SPEC)
    assert model.nodes[""].n == 64 and not model.nodes[""].leaf
    assert sum(x.n for x in model.nodes.values() if x.depth == 1) == 64
    assert tree.fit(ints, SPEC, max_depth=0).nodes[""].class_label == 0
    assert tree.fit(ints.limit(0), SPEC).nodes[""].class_label == -1


def test_table_model_equals_literals(spark, ints):
    literal, table = bayes.fit(ints, SPEC), bayes.fit_table(ints, SPEC)
    odd = spark.createDataFrame([(900, [9, 9], 0), (901, [0, 9], 1)], ints.schema)
    rows = ints.unionByName(odd)
    for most in (200_000, 0):  # broadcast, and shuffled with salt
        assert sorted((r.row_id, r.pred) for r in table.predict(rows, 3, most).collect()) == predictions(literal, rows)
    assert "map(" not in table.predict(rows)._jdf.queryExecution().optimizedPlan().toString().replace("map_from_entries(", "")


def test_bounds_leave_out_distances_but_change_nothing(spark, points):
    spec = o.DatasetSpec(num_features=3, num_classes=4, k=4, em_iters=8)
    model = kmeans.fit(points, spec)
    rows = [(r.row_id, np.array(r.features)) for r in points.collect()]
    centroids = [np.array(r.features) for r in kmeans.seeds(points, spec).orderBy("k").collect()]
    for _ in range(spec.em_iters):
        at = [int(np.argmin([((x - c) ** 2).sum() for c in centroids])) for _, x in rows]
        centroids = [np.mean([x for (_, x), a in zip(rows, at, strict=True) if a == k], axis=0) if k in at else np.zeros(2) for k in range(4)]
    assert np.allclose([c.centroid for c in model.clusters], centroids)
    assert [c.n for c in model.clusters] == [at.count(k) for k in range(4)]
    assert len(rows) * 4 <= model.distances < len(rows) * 4 * spec.em_iters / 2


def test_program_runs_a_whole_grid_once(spark, tmp_path):
    data, out = tmp_path / "d.csv", str(tmp_path / "out")
    draw = np.random.default_rng(2)
    data.write_text("40,3,2\n" + "".join(f"{draw.normal() + 5 * (i % 2):.3f},{draw.normal():.3f},{i % 2}\n" for i in range(40)))
    spec = o.DatasetSpec(num_features=3, num_classes=2, em_iters=2)
    obs = o.read_csv(spark, str(data), 3, "double").persist()
    small = [c for c in grid("kmeans", spec, "naive") if c.iter_size <= 32]
    assert len(small) == 10 and sum(runnable("kmeans", c) for c in small) == 4
    made = run_grid(spark, obs, spec, 31, out, 1, small)
    assert [(r["i"], r["k"]) for r in made] == [(16, 10), (32, 10), (32, 20), (32, 30)]
    assert recorded(spark, out) == {(31, r["k"], r["f"], r["i"]) for r in made}
    assert run_grid(spark, obs, spec, 31, out, 1, small) == []
    assert len(grid("tree", spec, "naive")) == 4 and len(grid("bayes", spec, "randomized")) == 12


@pytest.mark.parametrize("code", [11, 22, 31])
def test_program(spark, tmp_path, code):
    data, out = tmp_path / "d.csv", str(tmp_path / "out")
    data.write_text("32,3,2\n" + "".join(f"{i % 2},{i % 3},{i % 2}\n" for i in range(32)))
    arguments = [str(data), "--code", str(code), "--out", out, "--runs", "1", "--first"]
    made = program.main(arguments)
    assert [(r["code"], r["i"], r["Accuracy"]) for r in made] == [(code, 16, 1.0)]
    assert program.main(arguments) == []


def test_truncated_products(spark):
    rows = spark.createDataFrame([(0, [1], 1), (1, [1], 1), (2, [0], 0)], "row_id long, features array<int>, label int")
    model = bayes.BayesModel({1: 1.0}, {(1, 0, 1): 1.0, (1, 0, 0): 0.4}, 2, 1)
    preds = lambda **k: [r.pred for r in model.predict_truncated(rows, **k).orderBy("row_id").collect()]
    assert preds(label_factor=False) == [1, 1, 0] and preds() == [0, 0, 0]
    doubled = bayes.BayesModel({1: 0.5}, {(1, 0, 1): 4.0, (1, 0, 0): 1.5}, 2, 1)
    assert [r.pred for r in doubled.predict_truncated(rows, label_factor=False, every_step=False).orderBy("row_id").collect()] == [1, 1, 0]
    assert [r.pred for r in doubled.predict_truncated(rows, label_factor=False).collect()] == [0, 0, 0]


def test_literal_padding_counts_on_the_first_chunk(spark, ints):
    e = Experiment(ints, SPEC, "bayes", "randomized", "literal")
    rows = e.augmented(o.chunked(ints, 8)).where("row_id < 0").collect()
    assert {(tuple(r.features), r.label) for r in rows if r.chunk_id == 0 and r.is_real} == {((0, 0), 0)}
    assert not any(r.is_real for r in rows if r.chunk_id > 0)
    assert e.predict(e.fit()).where("is_real").count() == 72


def test_draws_are_the_same_in_either_form(spark, monkeypatch):
    h = [0, 1, 12345, 0xFFFFFFFF]
    df = spark.createDataFrame([(x,) for x in h], "h long")
    want = decoys.spread(np.array(h, np.uint64)[:, None], np.arange(3, dtype=np.uint64)).tolist()
    assert [[r[0], r[1], r[2]] for r in df.select(*(s.spread32(F.col("h"), p).alias(str(p)) for p in range(3))).collect()] == want
    for kind, highs in (("int", [0, 7, None, 10**6]), ("double", [0.3, 7.5, None, -2.0])):
        native = [r.x for r in df.select(decoys.drawn_features(F.col("h"), highs, kind).alias("x")).collect()]
        monkeypatch.setattr(decoys, "WIDEST", 0)
        assert [r.x for r in df.select(decoys.drawn_features(F.col("h"), highs, kind).alias("x")).collect()] == native
        monkeypatch.undo()
        tops = [1.0 if t is None or 0 <= t < 1 else t for t in highs] if kind == "double" else [t or 0 for t in highs]
        assert all(0 <= v < max(t, 1) if t > 0 else v == 0 for x in native for v, t in zip(x, tops, strict=True))


def test_overall_shuffle_is_a_permutation(spark, ints):
    got = decoys.shuffled(ints, SPEC, within_chunk=False).select("row_id", "pos").collect()
    order = {r.row_id: r.h for r in ints.select("row_id", s.hash32(F.lit(SPEC.seed), F.col("row_id")).alias("h")).collect()}
    assert [r.row_id for r in sorted(got, key=lambda r: r.pos)] == sorted(order, key=lambda i: (order[i], i))
