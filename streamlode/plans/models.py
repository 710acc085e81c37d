"""Model tables: trees, Bayes models and clusters saved as numbered versions, with the spec they were fitted for."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators.bayes import BayesModel, BayesTable
from ..operators.kmeans import Cluster, KMeansModel
from ..operators.tree import Node, TreeModel
from ..sources.observations import DatasetSpec

#: What a model depends on; a saved model fits another spec only if these agree.
BOUND = {"tree": ("num_features", "num_classes", "num_values"), "bayes": ("num_features", "num_classes"), "bayes_table": ("num_features", "num_classes"), "kmeans": ("num_features", "num_classes", "k")}
ABOUT = "version int, kind string, spec string"


def kind_of(model) -> str:
    return {TreeModel: "tree", BayesModel: "bayes", BayesTable: "bayes_table", KMeansModel: "kmeans"}[type(model)]


def tables(model, spark: SparkSession) -> dict[str, DataFrame]:
    """The tables that make up a model."""
    if isinstance(model, BayesTable):
        return {"prior": model.prior, "cells": model.cells}
    if isinstance(model, BayesModel):
        prior = spark.createDataFrame(list(model.prior.items()), "c int, p double")
        return {"prior": prior, "cells": spark.createDataFrame([(*key, p) for key, p in model.cond.items()], "c int, f int, v int, p double")}
    return {"clusters" if isinstance(model, KMeansModel) else "nodes": model.frame(spark)}


def versions(spark: SparkSession, path: str) -> DataFrame:
    """version, kind and spec (JSON) of all complete models at path."""
    try:
        return spark.read.schema(ABOUT).json(f"{path}/about")
    except AnalysisException:  # nothing saved yet
        return spark.createDataFrame([], ABOUT)


def save(model, spec: DatasetSpec, path: str, spark: SparkSession) -> int:
    """Write a model as the next version at path and return its number. The entry that makes it known is written last; one writer at a time."""
    version = (versions(spark, path).agg(F.max("version")).first()[0] or 0) + 1
    for name, table in tables(model, spark).items():
        table.write.mode("overwrite").parquet(f"{path}/version={version}/{name}")  # what a broken attempt left goes
    spark.createDataFrame([(version, kind_of(model), json.dumps(asdict(spec)))], ABOUT).coalesce(1).write.mode("append").json(f"{path}/about")
    return version


def load(spark: SparkSession, path: str, spec: DatasetSpec, version: int | None = None):
    """The model of a version (the newest, if None). ValueError if there is none, or if it was fitted for data of another form than spec."""
    known = versions(spark, path)
    found = (known if version is None else known.where(F.col("version") == version)).orderBy(F.col("version").desc()).first()
    if found is None:
        raise ValueError(f"no model {'' if version is None else version} at {path}")
    saved = json.loads(found["spec"])
    other = [x for x in BOUND[found["kind"]] if saved[x] != getattr(spec, x)]
    if other:
        raise ValueError("the model was fitted for other data: " + ", ".join(f"{x} {saved[x]}, not {getattr(spec, x)}" for x in other))
    read = lambda name: spark.read.parquet(f"{path}/version={found['version']}/{name}")
    if found["kind"] == "tree":
        rows = sorted(read("nodes").collect(), key=lambda r: (r["depth"], r["node_id"]))
        return TreeModel({r["node_id"]: Node(**r.asDict()) for r in rows}, spec.num_values)
    if found["kind"] == "kmeans":
        return KMeansModel([Cluster(**r.asDict()) for r in read("clusters").orderBy("k").collect()])
    if found["kind"] == "bayes_table":
        return BayesTable(read("prior"), read("cells"), spec.num_classes, spec.num_features - 1)
    cond = {(r["c"], r["f"], r["v"]): r["p"] for r in read("cells").collect()}
    return BayesModel({r["c"]: r["p"] for r in read("prior").collect()}, cond, spec.num_classes, spec.num_features - 1)
