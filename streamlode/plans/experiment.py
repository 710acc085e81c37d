"""Experiments: an algorithm and a variant, fitted on chunk 0 and scored on every full chunk."""

from __future__ import annotations

import time
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators import bayes, decoys, kmeans, metrics, tree
from ..sources.observations import DatasetSpec, chunked, full_chunks, train_chunk

#: type code: algorithm and variant (fixed values)
CODES = {
    11: ("tree", "naive"), 12: ("tree", "oblivious"), 13: ("tree", "randomized"),
    21: ("bayes", "naive"), 22: ("bayes", "oblivious"), 23: ("bayes", "randomized"),
    31: ("kmeans", "naive"), 32: ("kmeans", "oblivious"), 33: ("kmeans", "randomized"),
}


@dataclass(frozen=True)
class Experiment:
    """fit() and evaluate() for a dataset of row_id, features and label."""

    obs: DataFrame
    spec: DatasetSpec
    algorithm: str = "bayes"
    variant: str = "naive"
    semantics: str = "intended"

    @classmethod
    def of(cls, obs: DataFrame, spec: DatasetSpec, code: int, semantics: str = "intended") -> Experiment:
        return cls(obs, spec, *CODES[code], semantics)

    def augmented(self, rows: DataFrame) -> DataFrame:
        """The rows that the variant works on: decoys beside the real rows for the randomised one."""
        if self.variant != "randomized":
            return rows
        clusters = self.algorithm == "kmeans"
        return decoys.augment(rows, self.spec, "double" if clusters else "int", not clusters, literal=self.semantics == "literal" and not clusters)

    def fit(self):
        rows = self.augmented(chunked(train_chunk(self.obs, self.spec.iter_size), self.spec.iter_size))
        literal = self.semantics == "literal"
        if self.algorithm == "tree":
            capped = self.variant == "randomized"
            return tree.fit(rows, self.spec, self.spec.max_depth if capped else None, cap="none" if literal else "majority")
        if self.algorithm == "bayes":
            return bayes.fit(rows, self.spec)  # literal quirks of Bayes are in its scores
        return kmeans.fit(rows, self.spec, votes="literal" if literal and self.variant == "oblivious" else "intended")

    def predict(self, model, sequential: bool = False) -> DataFrame:
        """Predictions for the rows of every full chunk. Decoys of the randomised variant are there too, without one (null): masks leave them out of all that follows."""
        rows = self.augmented(full_chunks(self.obs, self.spec.iter_size))
        if "is_real" in rows.columns and not sequential:
            return self.scored(model, rows.where("is_real")).unionByName(rows.where("not is_real"), allowMissingColumns=True)
        return self.scored(model, rows, sequential)

    def scored(self, model, rows: DataFrame, sequential: bool = False) -> DataFrame:
        if self.algorithm == "tree":
            return model.predict(rows, shifted=self.semantics == "literal" and self.variant == "oblivious")
        if self.algorithm == "kmeans" and sequential:
            # decoys move no centroid; what differs between the variants is the order of the rows
            return model.predict_sequential(rows.where("is_real") if "is_real" in rows.columns else rows, order=decoys.chunk_order(self.spec, self.variant))
        return model.predict(rows, self.semantics)

    def evaluate(self, model) -> DataFrame:
        return metrics.running(self.predict(model))

    def run(self, runs: int = 5) -> list[dict]:
        """Timed evaluations; fitting is not timed."""
        out = []
        for _ in range(runs):
            model = self.fit()
            began = time.perf_counter()
            row = metrics.accuracy(self.predict(model)).first()
            out.append({"k": self.spec.k, "f": self.spec.fake_size, "i": self.spec.iter_size, "Time": time.perf_counter() - began, "Accuracy": row["accuracy"] or 0.0})
        return out


def grid(algorithm: str, spec: DatasetSpec, variant: str = "randomized") -> list[DatasetSpec]:
    """The configurations of the experiment design: chunk sizes, padding factors (of the randomised variant alone) and cluster counts (k-means).

    Pairs of a chunk size and a larger cluster count are there too, as ``runnable`` tells.
    """
    out = [replace(spec, iter_size=i) for i in (16, 32, 64, 128)]
    out = [replace(s, fake_size=p) for s in out for p in ((2, 4, 8) if variant == "randomized" else (spec.fake_size,))]
    return [replace(s, k=k) for s in out for k in (10, 20, 30, 40, 50)] if algorithm == "kmeans" else out


def runnable(algorithm: str, spec: DatasetSpec) -> bool:
    """Whether the training chunk holds as many rows as clusters ask for."""
    return algorithm != "kmeans" or spec.k <= spec.iter_size



def recorded(spark, path: str) -> set[tuple[int, int, int, int]]:
    """code, k, f and i of the configurations that have a line at path."""
    try:
        lines = spark.read.text(path)
    except AnalysisException:  # no run yet
        return set()
    part = lambda name: F.regexp_extract("value", rf"(?:^|\t){name}=([0-9]+)", 1).try_cast("int").alias(name)
    return {tuple(r) for r in lines.select(part("code"), part("k"), part("f"), part("i")).collect()}  # one for each configuration


def run_grid(spark, obs: DataFrame, spec: DatasetSpec, code: int, out: str, runs: int = 5, configurations: list[DatasetSpec] | None = None) -> list[dict]:
    """Run the grid of a type code (or the given configurations) and append a line for each to out, times and accuracies summed over the runs.

    Configurations that have a line already are not run again, those whose clusters outnumber the chunk are left out; what was run is returned.
    """
    algorithm, variant = CODES[code]
    done, made = recorded(spark, out), []
    for config in configurations or grid(algorithm, spec, variant):
        if not runnable(algorithm, config) or (code, config.k, config.fake_size, config.iter_size) in done:
            continue
        results = Experiment.of(obs, config, code).run(runs)
        record = {"code": code} | {x: sum(r[x] for r in results) if x in ("Time", "Accuracy") else results[0][x] for x in results[0]}
        append_result(spark, out, record)
        made.append(record)
    return made


def append_result(spark, path: str, record: dict) -> None:
    """Append a record as a tab-separated line k=.., f=.., i=.., Time=.., Accuracy=.."""
    line = "\t".join(f"{k}={v}" for k, v in record.items())
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(path)


def append_blob(spark, path: str, data: bytes) -> None:
    """Append a blob followed by a line feed."""
    spark.createDataFrame([(bytearray(data),)], "b binary").select(F.col("b").cast("string").alias("value")).coalesce(1).write.mode("append").text(path)
