"""Multiway decision tree by information gain, grown a level at a time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import plogp
from ..sources.observations import DatasetSpec, to_long


def class_shares(rows: DataFrame, by: str = "node_id") -> DataFrame:
    """by, label, n, share of the node's rows."""
    counts = rows.groupBy(by, "label").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(by)))


def entropies(rows: DataFrame, by: str = "node_id") -> DataFrame:
    """by, n, classes, majority (ties to the lowest) and entropy (natural log)."""
    return class_shares(rows, by).groupBy(by).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("classes"), (-F.max(F.struct("n", -F.col("label"))).getField("col2")).alias("majority"), F.sum(plogp(F.col("p"))).alias("entropy")
    )


def contingency(rows: DataFrame, by: str = "node_id") -> DataFrame:
    """by, f, v, label, n: one job for all nodes and features."""
    return to_long(rows.select(by, "features", "label")).groupBy(by, "f", "v", "label").agg(F.count(F.lit(1)).alias("n"))


def conditional_entropies(rows: DataFrame, by: str = "node_id") -> DataFrame:
    """by, f, entropy of the label once the feature is known."""
    cell, node = Window.partitionBy(by, "f", "v"), Window.partitionBy(by, "f")
    part = contingency(rows, by).withColumns({"nv": F.sum("n").over(cell), "all": F.sum("n").over(node)})
    return part.groupBy(by, "f").agg(F.sum(F.col("nv") / F.col("all") * plogp(F.col("n") / F.col("nv"))).alias("conditional"))


def gains(rows: DataFrame, by: str = "node_id") -> DataFrame:
    """by, f, gain."""
    return conditional_entropies(rows, by).join(entropies(rows, by).select(by, "entropy"), by).select(by, "f", F.round(F.col("entropy") - F.col("conditional"), 9).alias("gain"))


def best_splits(rows: DataFrame, by: str = "node_id") -> DataFrame:
    """by, split_attr, gain: the largest gain above 0, ties to the lowest feature. rows has ``used`` (array) if features are spent."""
    found = gains(rows, by)
    if "used" in rows.columns:
        found = found.join(rows.groupBy(by).agg(F.first("used").alias("used")), by).where(~F.array_contains("used", F.col("f")))
    return found.where("gain > 0").groupBy(by).agg(F.max(F.struct("gain", (-F.col("f")).alias("g"))).alias("b")).select(by, (-F.col("b.g")).alias("split_attr"), F.col("b.gain").alias("gain"))


@dataclass
class Node:
    node_id: str
    parent_id: str | None
    parent_value: int | None
    depth: int
    split_attr: int = -1
    class_label: int = -1
    leaf: bool = True
    n: int = 0
    decoy: bool = False


SCHEMA = "node_id string, parent_id string, parent_value int, depth int, split_attr int, class_label int, leaf boolean, n long, decoy boolean"


@dataclass
class TreeModel:
    """Nodes by path: the path of a child is its parent's and the value that leads to it."""

    nodes: dict[str, Node]
    num_values: int

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(x.node_id, x.parent_id, x.parent_value, x.depth, x.split_attr, x.class_label, x.leaf, x.n, x.decoy) for x in self.nodes.values()], SCHEMA)

    def depth(self) -> int:
        return max(x.depth for x in self.nodes.values())

    def end(self, shifted: bool = False) -> Column:
        """Where a row's walk ends: the place of a node in ``nodes``, below 0 where there is no child. The tree is two literal arrays: no join.

        shifted routes each value to the child of the value before it, as one of the original variants does;
        value 0 has no such child.
        """
        place = {key: i for i, key in enumerate(self.nodes)}
        attrs = literal_array(x.split_attr if not x.leaf else -1 for x in self.nodes.values())
        below = literal_array(place.get(f"{key}/{v}", -1) for key in self.nodes for v in range(self.num_values))
        width = self.num_values

        def step(i, _):
            attr = F.get(attrs, i)
            value = F.get("features", attr) - (1 if shifted else 0)
            child = F.when((value >= 0) & (value < width), F.get(below, i * width + value)).otherwise(-1)
            return F.when((i < 0) | (attr < 0), i).otherwise(F.coalesce(child, F.lit(-1)))

        return F.aggregate(F.sequence(F.lit(1), F.lit(max(self.depth(), 1))), F.lit(0), step)

    def predict(self, rows: DataFrame, shifted: bool = False) -> DataFrame:
        """Add pred, -1 where a path ends without a label; see ``end`` for shifted."""
        labels, end = literal_array(x.class_label for x in self.nodes.values()), self.end(shifted)
        return rows.withColumn("pred", F.when(end < 0, -1).otherwise(F.get(labels, end)))


def literal_array(values) -> Column:
    """Whole numbers as one constant, which the optimiser folds."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def grown_level(cells: DataFrame, used: DataFrame) -> DataFrame:
    """place, n, classes, majority, split_attr (null if no gain) and values (those that occur at the split) of each open node.

    cells: place, f, v, label, n, the counts of a level. used: place and the features spent on the path to it.
    """
    cell, node = Window.partitionBy("place", "f", "v"), Window.partitionBy("place", "f")
    about = cells.where("f = 0").groupBy("place", "label").agg(F.sum("n").alias("n"))
    about = about.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("place"))).groupBy("place").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("classes"), (-F.max(F.struct("n", -F.col("label"))).getField("col2")).alias("majority"), F.sum(plogp(F.col("p"))).alias("entropy")
    )
    parts = cells.withColumns({"nv": F.sum("n").over(cell), "all": F.sum("n").over(node)})
    known = parts.groupBy("place", "f").agg(F.sum(F.col("nv") / F.col("all") * plogp(F.col("n") / F.col("nv"))).alias("conditional"), F.sort_array(F.collect_set("v")).alias("values"))
    gain = F.round(F.col("entropy") - F.col("conditional"), 9)
    # one row for each open node, as many as the model holds
    found = known.join(about.select("place", "entropy"), "place").join(F.broadcast(used), "place").where(~F.array_contains("used", F.col("f"))).select("place", "f", gain.alias("gain"), "values").where("gain > 0")
    best = found.groupBy("place").agg(F.max(F.struct("gain", (-F.col("f")).alias("g"), "values")).alias("b"))
    return about.join(best, "place", "left").select("place", "n", "classes", "majority", (-F.col("b.g")).alias("split_attr"), F.col("b.values").alias("values"))


def fit(rows: DataFrame, spec: DatasetSpec, max_depth: int | None = None, label_exhausted: str = "none", cap: str = "majority") -> TreeModel:
    """Grow the tree on rows of any count, a chunk or a whole table.

    Rows stay where they are: at each level they walk the tree so far, and one aggregation counts the cells (node, feature, value,
    class) of all open nodes, summed within tasks first. Only a row for each open node returns to the driver.

    label_exhausted: "none" leaves children unlabelled once every feature on the path is used, "majority"
    labels them. cap: what nodes at max_depth get, "majority" or "none". Rows with a null label or without features take no part.
    """
    rows = rows.where("is_real") if "is_real" in rows.columns else rows
    rows = rows.select("features", "label").where(F.col("label").isNotNull() & (F.size("features") > 0))
    spark, features = rows.sparkSession, spec.num_features - 1
    model = TreeModel({"": Node("", None, None, 0)}, spec.num_values)
    open_, paths = {"": model.nodes[""]}, {"": ()}
    while open_:
        place = {key: i for i, key in enumerate(model.nodes)}
        used = spark.createDataFrame([(place[k], list(paths[k])) for k in open_], "place int, used array<int>")
        is_open = literal_array(int(key in open_) for key in model.nodes)
        at = rows.withColumn("place", model.end()).where((F.col("place") >= 0) & (F.get(is_open, F.col("place")) == 1))
        cells = to_long(at).groupBy("place", "f", "v", "label").agg(F.count(F.lit(1)).alias("n"))
        # by node once: what follows needs no further shuffle. A node's cells are bounded by the domain, not by its rows
        cells = cells.repartition("place").persist()
        about = {r["place"]: r for r in grown_level(cells, used).collect()}
        cells.unpersist()
        grown = {}
        for key, node in open_.items():
            r = about.get(place[key])
            if r is None:
                continue
            node.n = r["n"]
            capped = max_depth is not None and node.depth >= max_depth
            if capped and cap == "none":
                continue
            if r["classes"] == 1 or capped or r["split_attr"] is None:
                node.class_label = r["majority"]
                continue
            node.leaf, node.split_attr = False, r["split_attr"]
            spent = (*paths[key], node.split_attr)
            for v in range(spec.num_values):
                child = Node(f"{key}/{v}", key, v, node.depth + 1)
                model.nodes[child.node_id] = child
                if v in r["values"] and (len(spent) < features or label_exhausted == "majority"):
                    grown[child.node_id], paths[child.node_id] = child, spent
        open_ = grown
    return model


def padded(model: TreeModel, spark: SparkSession, depth: int = 5) -> DataFrame:
    """depth and nodes: how many nodes each level has once every leaf is padded with copies of itself down to ``depth``."""
    levels: dict[int, int] = {}
    for node in model.nodes.values():
        levels[node.depth] = levels.get(node.depth, 0) + 1
        for below in range(node.depth + 1, depth + 1) if node.leaf else ():
            levels[below] = levels.get(below, 0) + model.num_values ** (below - node.depth)
    return spark.createDataFrame(sorted(levels.items()), "depth int, nodes long")
