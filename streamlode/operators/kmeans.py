"""K-means with labels by majority, and the model that each scored row moves."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import hash32, squared_distance
from ..sources.observations import DatasetSpec


@dataclass
class Cluster:
    k: int
    centroid: list[float]
    n: int = 0
    sums: list[float] = field(default_factory=list)
    class_prop: dict[int, int] = field(default_factory=dict)
    class_label: int = -1
    radius: float = 0.0
    empty: bool = False


SCHEMA = "k int, centroid array<double>, n long, sums array<double>, class_prop map<int,long>, class_label int, radius double, empty boolean"


def seeds(rows: DataFrame, spec: DatasetSpec) -> DataFrame:
    """The first K rows in the order of a seeded hash, as k and features. Top-K: no full sort."""
    order = hash32(F.lit(spec.seed), F.col("row_id"))
    top = rows.select("row_id", "features", order.alias("h")).orderBy("h", "row_id").limit(spec.k)
    from pyspark.sql import Window

    return top.withColumn("k", F.row_number().over(Window.orderBy("h", "row_id")) - 1).select("k", "row_id", "features")


def nearest(centroids: list[tuple[int, list[float]]], features: Column, cut: bool = False) -> Column:
    """struct(d, k) of the nearest centroid, ties to the lowest k. cut compares whole parts of the distances."""
    table = F.array(*(F.struct(F.lit(k).alias("k"), F.array(*map(F.lit, map(float, c))).alias("c")) for k, c in centroids))
    whole = lambda d: F.floor(d).cast("double") if cut else d
    return F.array_min(F.transform(table, lambda x: F.struct(whole(squared_distance(features, x["c"])).alias("d"), x["k"].alias("k"))))


def matrix(features) -> np.ndarray:
    """Arrays of a batch as a matrix; a null one is a row of NaN."""
    width = next((len(x) for x in features if x is not None), 0)
    return np.array([np.full(width, np.nan) if x is None else x for x in features], float).reshape(len(features), width)


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of rows and centroids, summed in the order of the features."""
    d = np.zeros((len(x), len(centroids)))
    for i in range(centroids.shape[1]):
        d += (x[:, i, None] - centroids[:, i]) ** 2
    return d


def assign(rows: DataFrame, clusters: list[Cluster], only_filled: bool = False, cut: bool = False) -> DataFrame:
    """Add k and distance. Centroids go with the function: a map over Arrow batches without a shuffle. Ties go to the lowest k; cut compares whole parts."""
    found = [c for c in clusters if not (only_filled and c.empty)]
    ks, centroids = np.array([c.k for c in found], np.int32), np.array([c.centroid for c in found], float)

    @F.pandas_udf("k int, d double")
    def near(features: pd.Series) -> pd.DataFrame:
        d = squared(matrix(features), centroids) if len(features) else np.zeros((0, len(ks)))
        d = np.floor(d) if cut else d
        at = d.argmin(1)
        return pd.DataFrame({"k": ks[at], "d": d[np.arange(len(d)), at]})

    return rows.withColumn("__near", near("features")).withColumns({"k": F.col("__near.k"), "distance": F.col("__near.d")}).drop("__near")


#: Relative and absolute slack of bounds against rounding.
SLACK = 1e-9


def bounded_step(rows: DataFrame, clusters: list[Cluster], before: list[Cluster] | None, last: bool) -> DataFrame:
    """rows with k (nearest cluster, ties to the lowest), upper, lower and computed, how many distances that took.

    upper bounds the distance to the row's centroid from above, lower that to all others from below. They are carried from step to step by how far
    the centroids moved since ``before``; where upper lies below lower, or below half the way to the next centroid,
    the row keeps its cluster without a distance. last: upper is made exact for all rows.
    """
    centroids = np.array([c.centroid for c in clusters])
    apart = np.sqrt(squared(centroids, centroids))
    np.fill_diagonal(apart, np.inf)
    half = apart.min(1) / 2
    moves = np.sqrt(((centroids - np.array([c.centroid for c in before])) ** 2).sum(1)) if before else np.zeros(len(clusters))
    others = np.array([np.delete(moves, i).max(initial=0.0) for i in range(len(moves))])

    def step(batches) -> Iterator:
        for b in batches:
            if not len(b):
                yield b
                continue
            x = matrix(b["features"])
            if before is None:
                k, upper, lower = np.zeros(len(x), int), np.full(len(x), np.inf), np.zeros(len(x))
            else:
                k, upper, lower = b["k"].to_numpy(), b["upper"].to_numpy() + moves[b["k"]], b["lower"].to_numpy() - others[b["k"]]
            computed, open_ = np.zeros(len(x), int), np.ones(len(x), bool)
            settled = lambda: upper * (1 + SLACK) + SLACK < np.maximum(lower, half[k])
            if before is not None:
                own = np.arange(len(x)) if last else np.flatnonzero(~settled())
                upper[own] = np.sqrt(((x[own] - centroids[k[own]]) ** 2).sum(1))
                computed[own] += 1
                open_ = ~settled()
            at = np.flatnonzero(open_)
            if len(at):
                d = squared(x[at], centroids)
                k[at] = d.argmin(1)
                two = np.sort(np.sqrt(d), 1)[:, :2]
                upper[at], lower[at] = two[:, 0], two[:, -1] if d.shape[1] > 1 else np.inf
                computed[at] += d.shape[1]
            yield b.assign(k=k.astype(np.int32), upper=upper, lower=lower, computed=computed)

    return rows.mapInPandas(step, rows.schema)


def statistics(assigned: DataFrame, width: int) -> DataFrame:
    """k, n, sums, radius of each cluster that has rows."""
    sums = F.expr(f"array({', '.join(f'sum(get(features, {i}))' for i in range(width))})")
    computed = [F.sum("computed").alias("computed")] if "computed" in assigned.columns else []
    return assigned.groupBy("k").agg(F.count(F.lit(1)).alias("n"), sums.alias("sums"), F.max("distance").alias("radius"), *computed)


def class_histogram(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("k", "label").agg(F.count(F.lit(1)).alias("n"))


@dataclass
class KMeansModel:
    """The clusters, and how many distances of rows their fit took."""

    clusters: list[Cluster]
    distances: int = 0

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(c.k, c.centroid, c.n, c.sums, c.class_prop, c.class_label, c.radius, c.empty) for c in self.clusters], SCHEMA)

    def predict(self, rows: DataFrame, semantics: str = "intended") -> DataFrame:
        """Add k, distance and pred with the clusters as they are."""
        found = assign(rows, self.clusters, only_filled=True, cut=semantics == "literal")
        labels = F.create_map(*(x for c in self.clusters for x in (F.lit(c.k), F.lit(c.class_label))))
        return found.withColumn("pred", labels[F.col("k")])

    def predict_sequential(self, rows: DataFrame, frozen: bool = False, order: tuple[Column, ...] = ()) -> DataFrame:
        """row_id, chunk_id, label, k, pred of rows in the given order (by row_id if none); each row then moves the centroid that took it."""
        return predict_each({"": self}, rows, frozen, order).drop("model")


def predict_each(models: dict[str, KMeansModel], rows: DataFrame, frozen: bool = False, order: tuple[Column, ...] = ()) -> DataFrame:
    """model, row_id, chunk_id, label, k, pred: each model folds all rows in the given order (ties by row_id), as ``predict_sequential`` tells.

    Every prediction depends on all rows before it, so a model is one task; it streams the rows through, sorted by Spark, and
    holds the clusters alone. Models run side by side.
    """

    def run(batches) -> Iterator:
        name, state = None, None
        for b in batches:
            for model, part in b.groupby("model", sort=False):
                if model != name:
                    name, state = model, Fold(models[model].clusters)
                found = [state.take(np.asarray(x, float), frozen) for x in part["features"]]
                yield pd.DataFrame({"model": model, "row_id": part["row_id"], "chunk_id": part["chunk_id"], "label": part["label"], "k": [k for k, _ in found], "pred": [p for _, p in found]})

    keys = [c.alias(f"order{i}") for i, c in enumerate(order)]
    each = rows.select(F.explode(F.array(*map(F.lit, sorted(models)))).alias("model"), "row_id", "chunk_id", "label", "features", *keys)
    ordered = each.repartition(len(models), "model").sortWithinPartitions("model", *(f"order{i}" for i in range(len(order))), "row_id")
    return ordered.select("model", "row_id", "chunk_id", "label", "features").mapInPandas(run, "model string, row_id long, chunk_id long, label int, k int, pred int")


class Fold:
    """The state of sequential prediction: sums and counts of the clusters that have members."""

    def __init__(self, clusters: list[Cluster]):
        full = [c for c in clusters if not c.empty]
        self.k, self.label = [c.k for c in full], [c.class_label for c in full]
        self.sums, self.n = np.array([c.sums for c in full], float), np.array([c.n for c in full], float)
        self.centroid = np.array([c.centroid for c in full], float)

    def restore(self, n: np.ndarray, sums: np.ndarray) -> None:
        """Go on from counts and (flat) sums of an earlier fold over the same clusters."""
        self.n, self.sums = n, sums.reshape(self.sums.shape)
        self.centroid = self.sums / n[:, None]

    def take(self, x: np.ndarray, frozen: bool = False) -> tuple[int, int]:
        d = np.zeros(len(self.centroid))
        for i in range(self.centroid.shape[1]):  # summed in the order of the features
            d += (x[i] - self.centroid[:, i]) ** 2
        j = int(d.argmin())
        if not frozen:
            self.sums[j] += x
            self.n[j] += 1
            self.centroid[j] = self.sums[j] / self.n[j]
        return self.k[j], self.label[j]


def fit(rows: DataFrame, spec: DatasetSpec, seed_from: str = "real", votes: str = "intended") -> KMeansModel:
    """A fixed count of EM steps on a training chunk, or a whole table; K rows return from each. Distances that bounds make needless are not computed.

    Only real rows enter the sums. seed_from="all" lets decoys be seeds. votes="literal" counts every member
    for every class, so the first class wins.
    """
    real = rows.where("is_real") if "is_real" in rows.columns else rows
    start = seeds(rows if seed_from == "all" else real, spec).collect()
    if len(start) < spec.k:
        raise ValueError(f"{spec.k} clusters need as many rows in the training chunk")
    clusters = [Cluster(r["k"], list(map(float, r["features"]))) for r in start]
    width, before, distances = len(clusters[0].centroid), None, 0
    state = real.select("row_id", "label", F.col("features").cast("array<double>").alias("features"), F.lit(0).alias("k"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower"), F.lit(0).cast("long").alias("computed"))
    for step in range(spec.em_iters):
        # cached for the aggregates and the next step; lost blocks are made again from the rows
        found, state = state, bounded_step(state, clusters, before, step == spec.em_iters - 1).persist()
        assigned = state.withColumn("distance", F.col("upper") * F.col("upper"))
        about = {r["k"]: r for r in statistics(assigned, width).collect()}
        distances += sum(r["computed"] for r in about.values())
        if step == spec.em_iters - 1:
            votes_of: dict[int, dict[int, int]] = {}
            for r in class_histogram(assigned).collect():
                votes_of.setdefault(r["k"], {})[r["label"]] = r["n"]
        found.unpersist()
        fresh = []
        for c in clusters:
            r = about.get(c.k)
            if r is None:  # an empty cluster goes to the origin and competes again
                fresh.append(Cluster(c.k, [0.0] * width, 0, [0.0] * width, empty=True))
            else:
                fresh.append(Cluster(c.k, [s / r["n"] for s in r["sums"]], r["n"], list(r["sums"]), radius=r["radius"]))
        before, clusters = clusters, fresh
    state.unpersist()
    for c in clusters:
        c.class_prop = votes_of.get(c.k, {})
        if votes == "literal":  # each member counts for every class
            c.class_prop = {y: sum(c.class_prop.values()) for y in range(spec.num_classes)} if c.class_prop else {}
        if c.class_prop:
            c.class_label = min(c.class_prop, key=lambda x: (-c.class_prop[x], x))
    return KMeansModel(clusters, distances)


def drawn_rows(rows: DataFrame, spec: DatasetSpec) -> DataFrame:
    """k and the row at a random index below iter_size, drawn with replacement: a join on the K indexes, whatever the count of rows."""
    spark = rows.sparkSession
    index = F.pmod(hash32(F.lit(spec.seed), F.lit("seed"), F.col("k")), F.lit(spec.iter_size))
    drawn = spark.range(spec.k).select(F.col("id").cast("int").alias("k")).withColumn("row_id", index)
    return rows.join(F.broadcast(drawn), "row_id")  # K rows


def reset(clusters: list[Cluster]) -> list[Cluster]:
    """The clusters without members: centroids stay, sums, counts, votes, labels and radii go."""
    return [Cluster(c.k, list(c.centroid), 0, [0.0] * len(c.centroid)) for c in clusters]
