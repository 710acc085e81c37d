"""Categorical naive Bayes without smoothing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..sources.observations import DatasetSpec, to_long


def priors(rows: DataFrame) -> DataFrame:
    """label, n and share of the real rows."""
    real = rows.where("is_real") if "is_real" in rows.columns else rows
    counts = real.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def conditionals(rows: DataFrame) -> DataFrame:
    """label, f, v, n and the share of the label's rows with that value."""
    real = rows.where("is_real") if "is_real" in rows.columns else rows
    counts = to_long(real.select("row_id", "features", "label")).groupBy("label", "f", "v").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("label", "f")))


@dataclass(frozen=True)
class BayesModel:
    """Probabilities by class and by (class, feature, value); absent means 0. At most one entry for each training cell."""

    prior: dict[int, float]
    cond: dict[tuple[int, int, int], float]
    num_classes: int
    num_features: int

    def predict(self, rows: DataFrame, semantics: str = "intended") -> DataFrame:
        """Add pred. Evaluated row by row from literals: no join and no shuffle."""
        if semantics == "literal":
            return self.predict_truncated(rows)
        return rows.withColumn("__best", self.best()).withColumn("pred", F.when(F.col("__best.ok"), -F.col("__best.c")).otherwise(F.lit(0))).drop("__best")

    def predict_truncated(self, rows: DataFrame, label_factor: bool = True, every_step: bool = True) -> DataFrame:
        """Add pred as whole-number products give it: the first class of the largest product.

        every_step: the product, which begins with the prior, is cut to a whole number at each factor; else only when products are
        compared, and the prior is the last factor. label_factor: the label's column is multiplied in as well, whose shares were
        never counted and are 0.
        """
        whole = lambda x: F.floor(x).cast("double") if every_step else x  # noqa: E731  shares are not negative

        def product(c: int) -> Column:
            prior, shares = F.lit(self.prior.get(c, 0.0)), []
            for f in range(self.num_features):
                cells = sorted((v, p) for (k, g, v), p in self.cond.items() if k == c and g == f and v is not None)
                table = F.create_map(*(x for v, p in cells for x in (F.lit(v), F.lit(p)))) if cells else None
                shares.append(F.coalesce(F.try_element_at(table, F.get("features", F.lit(f))), F.lit(0.0)) if cells else F.lit(0.0))
            first, *rest = [prior, *shares] if every_step else [*shares, prior]  # doubles round by their order
            score = whole(first)
            for factor in rest:
                score = whole(score * factor)
            return F.floor(score * F.lit(0.0) if label_factor else score)

        top = F.array_max(F.array(*(F.struct(product(c).alias("s"), F.lit(-c).alias("c")) for c in range(self.num_classes))))
        return rows.withColumn("pred", -top["c"])

    def predict_scanning(self, rows: DataFrame, num_values: int) -> DataFrame:
        """Add pred as a scan over all num_values of each feature would give it (by the same lookup): a value outside the domain leaves the score as it is."""
        outside = [~F.coalesce(F.get("features", F.lit(f)).between(0, num_values - 1), F.lit(False)) for f in range(self.num_features)]
        return rows.withColumn("__best", self.best(outside)).withColumn("pred", F.when(F.col("__best.ok"), -F.col("__best.c")).otherwise(F.lit(0))).drop("__best")

    def scores(self, rows: DataFrame) -> DataFrame:
        """row_id, label, c, score: the log of the class's score, null where it is 0."""
        each = F.explode(F.array(*(F.struct(F.lit(c).alias("c"), self.log_score(c).alias("s")) for c in range(self.num_classes)))).alias("e")
        return rows.select("row_id", "label", each).select("row_id", "label", F.col("e.c").alias("c"), F.round("e.s", 6).alias("score"))

    def log_score(self, c: int, outside: list | None = None):
        """The log of the class's score. outside: a condition for each feature under which it is passed over."""
        from math import log

        total = F.lit(log(self.prior[c]) if self.prior.get(c) else None).cast("double")
        for f in range(self.num_features):
            cells = {v: p for (k, g, v), p in self.cond.items() if k == c and g == f and p > 0}
            if cells:
                table = F.create_map(*(x for v, p in sorted(cells.items()) for x in (F.lit(v), F.lit(log(p)))))
                part = F.try_element_at(table, F.get("features", F.lit(f)))
            else:
                part = F.lit(None).cast("double")
            total = total + (F.when(outside[f], 0.0).otherwise(part) if outside else part)
        return total

    def best(self, outside: list | None = None):
        """The class of the highest score; nulls are the least, so ok tells whether any class has a score."""
        scored = [F.struct(F.round(self.log_score(c, outside), 9).alias("s"), F.lit(-c).alias("c")) for c in range(self.num_classes)]
        top = F.array_max(F.array(*scored))
        return F.struct(top["s"].isNotNull().alias("ok"), top["c"].alias("c"))


@dataclass(frozen=True)
class BayesTable:
    """The model as tables, for domains whose cells are too many for literals.

    prior: c, log_p. cells: f, v and logs, an array with the log of the cell's share in each class (null where it is 0).
    """

    prior: DataFrame
    cells: DataFrame
    num_classes: int
    num_features: int

    def scores(self, rows: DataFrame, salts: int = 16, most_broadcast: int = 200_000) -> DataFrame:
        """row_id and logs, the log of each class's score (null where it is 0), by a join of the rows' cells with the model's.

        A table of at most ``most_broadcast`` cells is broadcast. A larger one is joined by a shuffle, with each cell in ``salts`` copies among
        which the rows are dealt, so that a value that a third of all rows have meets in no one task. The sums of a row's cells are made
        in the task that holds them before they move. Rows that share a row_id would be summed together: ids are distinct.
        """
        long = rows.select("row_id", F.posexplode("features").alias("f", "v"))
        if self.cells.count() <= most_broadcast:
            found = long.join(F.broadcast(self.cells), ["f", "v"], "left")
        else:
            dealt = self.cells.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
            found = long.withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(salts)).cast("int")).join(dealt, ["f", "v", "salt"], "left")
        part = lambda c: F.get("logs", F.lit(c))
        sums = found.groupBy("row_id").agg(*(F.sum(part(c)).alias(f"s{c}") for c in range(self.num_classes)), *(F.count(part(c)).alias(f"n{c}") for c in range(self.num_classes)))
        prior = F.broadcast(self.prior.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("c", "log_p"))).alias("prior")))  # a row of num_classes entries
        whole = lambda c: F.when(F.col(f"n{c}") == self.num_features, F.col(f"s{c}") + F.try_element_at("prior", F.lit(c)))
        return sums.join(prior).select("row_id", F.array(*(whole(c) for c in range(self.num_classes))).alias("logs"))

    def predict(self, rows: DataFrame, salts: int = 16, most_broadcast: int = 200_000) -> DataFrame:
        """row_id and pred: the class of the highest score, ties to the lowest, 0 if no class has any."""
        scored = self.scores(rows, salts, most_broadcast)
        top = F.array_max(F.array(*(F.struct(F.round(F.get("logs", F.lit(c)), 9).alias("s"), F.lit(-c).alias("c")) for c in range(self.num_classes))))
        return scored.select("row_id", F.when(top["s"].isNotNull(), -top["c"]).otherwise(0).alias("pred"))


def fit_table(rows: DataFrame, spec: DatasetSpec) -> BayesTable:
    """The model of ``fit`` as tables: nothing of it reaches the driver."""
    cond = conditionals(rows).groupBy("f", "v").agg(*(F.max(F.when(F.col("label") == c, F.ln("p"))).alias(f"l{c}") for c in range(spec.num_classes)))
    cells = cond.select("f", "v", F.array(*(f"l{c}" for c in range(spec.num_classes))).alias("logs"))
    return BayesTable(priors(rows).where("label is not null").select(F.col("label").alias("c"), F.ln("p").alias("log_p")), cells, spec.num_classes, spec.num_features - 1)


def fit(rows: DataFrame, spec: DatasetSpec) -> BayesModel:
    prior = {r["label"]: r["p"] for r in priors(rows).collect()}
    cond = {(r["label"], r["f"], r["v"]): r["p"] for r in conditionals(rows).collect()}
    return BayesModel(prior, cond, spec.num_classes, spec.num_features - 1)
