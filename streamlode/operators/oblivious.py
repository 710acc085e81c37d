"""Trees filled up to a fixed depth, and walks that pass every level of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.observations import DatasetSpec
from .decoys import decoy_feature

#: A filled tree of more nodes than this is joined by a shuffle instead of a broadcast.
MOST_BROADCAST = 500_000


def filled(nodes: DataFrame, spec: DatasetSpec, decoy: bool) -> DataFrame:
    """nodes (see ``TreeModel.frame``) with num_values children below each leaf, level by level down to max_depth.

    decoy: the children are decoys without a label, and they and the leaf above split by a feature drawn for the node;
    else they are copies that carry the leaf's label and split by feature 0. Every level is an explode: no shuffle.
    """
    drawn = decoy_feature(F.col("node_id"), spec) if decoy else F.lit(0)
    columns = nodes.columns
    below = F.col("depth") < spec.max_depth
    splits = F.when(F.col("leaf") & below, drawn).otherwise(F.col("split_attr"))
    out = nodes.withColumn("split_attr", splits)
    edge = nodes.where(F.col("leaf") & below)
    for _ in range(spec.max_depth):
        child = edge.where(below).select(
            F.col("node_id").alias("parent_id"), F.explode(F.sequence(F.lit(0), F.lit(spec.num_values - 1))).alias("parent_value"), (F.col("depth") + 1).alias("depth"), "class_label"
        )
        edge = child.select(
            F.concat_ws("/", "parent_id", "parent_value").alias("node_id"), "parent_id", "parent_value", "depth", F.lit(-1).alias("split_attr"),
            (F.lit(-1) if decoy else F.col("class_label")).alias("class_label"), F.lit(True).alias("leaf"), F.lit(0).cast("long").alias("n"), F.lit(decoy).alias("decoy"),
        )
        out = out.unionByName(edge.withColumn("split_attr", splits))
    return out.select(columns)


def value_of(attr: Column) -> Column:
    """The value of a feature, counted with the label as the last one."""
    return F.coalesce(F.get("features", attr), F.when(attr == F.size("features"), F.col("label")))


def walk(rows: DataFrame, tree: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Add end_id, the node of the last level that a row comes to, and pred.

    Every row takes max_depth steps, whatever its leaf. pred is the label of the last real leaf passed (decoys have none), -1 without one;
    where a value lies outside the domain the path ends, with a null end_id.
    """
    nodes = tree.select(F.col("node_id").alias("__at"), F.col("split_attr").alias("__attr"), F.when(F.col("leaf") & ~F.col("decoy"), F.col("class_label")).alias("__label"))
    small = nodes.count() <= MOST_BROADCAST
    found = rows.withColumns({"end_id": F.lit(""), "pred": F.lit(-1)})
    for step in range(spec.max_depth + 1):
        found = found.join(F.broadcast(nodes) if small else nodes.hint("shuffle_hash"), F.col("end_id") == F.col("__at"), "left")
        found = found.withColumns({"pred": F.coalesce("__label", "pred"), "end_id": F.col("__at")})
        if step < spec.max_depth:
            value = value_of(F.col("__attr"))
            found = found.withColumn("end_id", F.when(value.between(0, spec.num_values - 1), F.concat_ws("/", "end_id", value)))
        found = found.drop("__at", "__attr", "__label")
    return found
