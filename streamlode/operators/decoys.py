"""Decoy rows, shuffles and masks: the data-level effects of the randomised variants."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import hash32, is_decoy, mux, spread32, uniform_double, uniform_int
from ..sources.observations import DatasetSpec


def ranges(rows: DataFrame, width: int, real_only: bool = True) -> DataFrame:
    """One row: lows and highs, arrays over the features."""
    real = F.col("is_real") if real_only and "is_real" in rows.columns else F.lit(True)
    v = lambda i: F.when(real, F.get("features", F.lit(i)))
    return rows.agg(F.array(*(F.min(v(i)) for i in range(width))).alias("lows"), F.array(*(F.max(v(i)) for i in range(width))).alias("highs"))


#: Features up to which draws are expressions; more of them outgrow generated code and are made by Arrow batches.
WIDEST = 16


def spread(h: np.ndarray, place: np.ndarray) -> np.ndarray:
    """``spread32`` for arrays of unsigned 64-bit numbers."""
    mask = np.uint64(0xFFFFFFFF)
    x = (h + place * np.uint64(2654435769) % np.uint64(1 << 32)) & mask
    for _ in range(2):
        x = ((x ^ (x >> np.uint64(16))) * np.uint64(73244475)) & mask
    return x ^ (x >> np.uint64(16))


def drawn_features(h: Column, highs: list, kind: str) -> Column:
    """A value below each maximum, all from one random number; doubles whose maximum is below 1 lie in [0, 1)."""
    tops = [0 if t is None else t for t in highs] if kind == "int" else [1.0 if t is None or 0 <= t < 1 else t for t in highs]
    if len(tops) <= WIDEST:
        one = (lambda f: uniform_int(spread32(h, f), F.lit(tops[f])).cast("int")) if kind == "int" else (lambda f: uniform_double(spread32(h, f), F.lit(tops[f])))
        return F.array(*(one(f) for f in range(len(tops))))
    steps = np.array(tops, np.int64) if kind == "int" else np.floor(np.array(tops, float) * 10000).astype(np.int64)

    @F.pandas_udf("array<int>" if kind == "int" else "array<double>")
    def drawn(numbers: pd.Series) -> pd.Series:
        x = spread(numbers.to_numpy(np.uint64)[:, None], np.arange(len(steps), dtype=np.uint64)).astype(np.int64)
        x = np.where(steps > 0, x % np.maximum(steps, 1), 0)
        return pd.Series(list(x.astype(np.int32) if kind == "int" else x / 10000.0))

    return drawn(h)


def drawn_apart(highs: list, *parts: Column) -> Column:
    """A double below each maximum, each from a digest of the parts and its place; those whose maximum is in [0, 1) lie in [0, 1), and without one it is 0."""
    tops = [0.0 if t is None else 1.0 if 0 <= t < 1 else float(t) for t in highs]
    return F.transform(F.array(*map(F.lit, tops)), lambda top, f: uniform_double(hash32(*parts, f), top))


def decoys(rows: DataFrame, spec: DatasetSpec, kind: str = "int", labelled: bool = True) -> DataFrame:
    """fake_size - 1 decoys for each row: features uniform below the real maximum of their column, is_real false.

    row_id of decoys is below 0. labelled: a uniform label, else -1. Doubles are drawn from a digest for each value, so that a row's are
    independent of each other; integers all from one. The maxima (one row) come to the driver.
    """
    width = spec.num_features - 1
    highs = ranges(rows, width).first()["highs"]
    h = F.col("h")
    drawn = drawn_features(h, highs, kind) if kind == "int" else drawn_apart(highs, F.lit(spec.seed), F.col("row_id"), F.col("copy"))
    label = uniform_int(spread32(h, width), F.lit(spec.num_classes)).cast("int") if labelled else F.lit(-1)
    rest = [c for c in rows.columns if c not in ("row_id", "features", "label", "is_real")]
    made = rows.select(*rest, "row_id", F.explode(F.sequence(F.lit(1), F.lit(spec.fake_size - 1)) if spec.fake_size > 1 else F.array().cast("array<int>")).alias("copy"))
    made = made.withColumn("h", hash32(F.lit(spec.seed), F.col("row_id"), F.col("copy"))).withColumn("features", drawn)
    return made.select(*rest, (-1 - F.col("row_id") * (spec.fake_size - 1) - F.col("copy") + 1).alias("row_id"), "features", label.alias("label"), F.lit(False).alias("is_real"))


def augment(rows: DataFrame, spec: DatasetSpec, kind: str = "int", labelled: bool = True, literal: bool = False) -> DataFrame:
    """Real rows and their decoys. literal: on chunk 0 what should be decoys are rows of zeros that count as real ones of class 0."""
    made = decoys(rows, spec, kind, labelled)
    if literal:
        first = F.col("chunk_id") == 0
        zeros = F.array_repeat(F.lit(0 if kind == "int" else 0.0), spec.num_features - 1)
        made = made.withColumns({"features": F.when(first, zeros).otherwise(F.col("features")), "label": F.when(first, 0).otherwise(F.col("label")), "is_real": first})
    return rows.withColumn("is_real", F.lit(True)).unionByName(made)


def shuffled(rows: DataFrame, spec: DatasetSpec, within_chunk: bool = True) -> DataFrame:
    """Add pos: the place of a row in a seeded order, within its chunk or overall.

    Overall, rows are numbered within the 2**12 ranges that the leading bits of the hash make, behind the counts of the ranges before, so that
    no task sees them all.
    """
    drawn, order = hash32(F.lit(spec.seed), F.col("row_id")), ("drawn", "row_id")
    rows = rows.withColumn("drawn", drawn)
    if within_chunk:
        return rows.withColumn("pos", F.row_number().over(Window.partitionBy("chunk_id").orderBy(*order)) - 1).drop("drawn")
    rows = rows.withColumn("range", F.shiftright("drawn", 20))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("range").agg(F.count(F.lit(1)).alias("size")).select("range", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    placed = rows.withColumn("place", place).join(F.broadcast(starts), "range")  # 4096 rows at most
    return placed.withColumn("pos", F.col("start") + F.col("place") - 1).drop("drawn", "range", "start", "place")


def chunk_order(spec: DatasetSpec, variant: str) -> tuple[Column, ...]:
    """The order in which a variant goes through its rows: by id, or chunk by chunk in the order of ``shuffled`` (oblivious) or ``permuted`` (randomised)."""
    drawn = hash32(F.lit(spec.seed), F.col("row_id"))
    if variant == "naive":
        return (F.col("row_id"),)
    return (F.col("chunk_id"), drawn if variant == "oblivious" else F.pmod(drawn, F.lit(spec.iter_size)), F.col("row_id"))


def resample_half(rows: DataFrame, spec: DatasetSpec, n: int) -> DataFrame:
    """Add kept: whether a uniform number below n is in its lower half."""
    return rows.withColumn("kept", F.pmod(hash32(F.lit(spec.seed), F.col("row_id")), F.lit(n)) < n // 2)


def permuted(rows: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Add key, drawn with replacement below iter_size, and pos: the place of a row in its chunk by key, then id."""
    key = F.pmod(hash32(F.lit(spec.seed), F.col("row_id")), F.lit(spec.iter_size))
    order = Window.partitionBy("chunk_id").orderBy("key", "row_id")
    return rows.withColumn("key", key).withColumn("pos", F.row_number().over(order) - 1)


def added(rows: DataFrame, spec: DatasetSpec, kind: str = "int") -> DataFrame:
    """Rows whose decoys have labels below 0 are shuffled in their chunk, flagged, and the decoys' features filled below the real maxima.

    Integer decoys get a uniform label, double ones keep -1. Adds pos and is_real. The maxima (one row) come to the driver.
    """
    width = spec.num_features - 1
    placed = (shuffled if kind == "int" else permuted)(rows, spec).withColumn("is_real", ~is_decoy(F.col("label")))
    highs = ranges(placed, width).first()["highs"]
    placed, h = placed.withColumn("h", hash32(F.lit(spec.seed), F.col("row_id"), F.lit("fill"))), F.col("h")
    filled = F.when(F.col("is_real"), F.col("features")).otherwise(drawn_features(h, highs, kind))
    label = F.when(F.col("is_real"), F.col("label")).otherwise(uniform_int(spread32(h, width), F.lit(spec.num_classes)).cast("int") if kind == "int" else F.lit(-1))
    return placed.withColumns({"features": filled, "label": label}).drop("h")


def decoy_feature(node: Column, spec: DatasetSpec) -> Column:
    """The feature that a decoy node splits by: uniform over all columns, that of the label included."""
    return F.pmod(hash32(F.lit(spec.seed), F.lit("node"), node), F.lit(spec.num_features)).cast("int")


def corrected(rows: DataFrame, spec: DatasetSpec, n: int) -> DataFrame:
    """rows: row_id, node_id, decoy, mask. The mask of a decoy node is drawn anew (a half of the rows) and its feature drawn; others keep theirs.

    Replaces mask and adds feature (-1 for real nodes).
    """
    drawn = F.pmod(hash32(F.lit(spec.seed), F.col("row_id")), F.lit(n)) < n // 2
    return rows.withColumns({"mask": mux(F.col("decoy"), drawn, F.col("mask")), "feature": F.when(F.col("decoy"), decoy_feature(F.col("node_id"), spec)).otherwise(-1)})
