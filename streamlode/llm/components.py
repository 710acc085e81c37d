"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, spread_join


def with_least(links: DataFrame, total: int) -> DataFrame:
    """links (u, v) with m, the least v of their u. The centres of large stars are not dealt to one task each."""
    least = links.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    return spread_join(links, least, ["u"], "n", total, F.xxhash64("v"))


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). Returns id, component (the smallest id reachable) for each id that is not its own component's smallest.

    Self-links, repeated links and links with a null end say nothing. Each round's edges are written to the
    shared folder, and those of the round before deleted; the links never reach the driver. Minima are aggregated
    before they are shuffled, and the edge count does not grow beyond the count of links and nodes.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links, state = materialize(links), None
    while True:
        now = links.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == state or not now[0]:
            return links.select(F.col("u").alias("id"), F.col("v").alias("component"))
        state = now
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both, 2 * now[0]).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = materialize(large)
        near = with_least(large, 2 * now[0])
        # each u keeps a link to its least neighbour, and so do its other neighbours
        small = near.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        fresh = materialize(small)
        discard(links, large)
        links = fresh
