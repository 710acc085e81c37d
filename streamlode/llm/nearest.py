"""Approximate nearest neighbours by an inverted multi-index.

Each half of a vector is quantised by its own centroids; a pair of centroids is a cell. A query orders the centroids of
either half by squared distance and takes pairs by the sum of both with a heap, nearest first, until the cells hold
``first`` rows; these are ranked by their true distance. Then it goes on over all pairs whose sum exceeds the squared distance of
its last neighbour so far by no more than a margin: what rows may lie nearer than their cell's sum says. The margin is a quantile of
that difference over the nearest neighbours of sample rows, so the share of neighbours that are found does not fall as the table grows.

Both passes are the same join: rows go to blocks of a first-half centroid, queries to the blocks of all centroids that they visit,
and each pair of blocks is one product of matrices, from which a query keeps its nearest. Blocks are bounded in rows and queries,
and every row of a visited cell is ranked. Of equal vectors only the ids that can be among the nearest are kept,
and these are as many as a query wants and one more (its own), so copies do not fill cells.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialize

#: Rows that the centroids and the margin are fitted on, at most (about; the bound is twice that).
SAMPLE = 32_768
#: Rows and queries in a block at most (about).
BLOCK = 8192


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows by matrix product: exact to rounding."""
    return np.maximum((a * a).sum(1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(1), 0.0)


def kmeans(points: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centroids of the points, from every n-th on; empty ones stay."""
    centres = points[:: max(1, len(points) // k)][:k].copy()
    for _ in range(rounds):
        at = np.concatenate([squares(points[i : i + 2048], centres).argmin(1) for i in range(0, len(points), 2048)])
        n, sums = np.bincount(at, minlength=len(centres)), np.zeros_like(centres)
        np.add.at(sums, at, points)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


class Grid:
    """The centroids of both halves, how many rows each cell has, and the margin."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        self.left, self.right, self.half = left, right, left.shape[1]
        self.counts = np.zeros((len(left), len(right)), np.int64)
        self.margin = 0.0

    def sums(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of the halves of x to the centroids of each half."""
        return squares(x[:, : self.half], self.left), squares(x[:, self.half :], self.right)

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.sums(x)
        return a.argmin(1), b.argmin(1)

    def reach(self, a: np.ndarray, b: np.ndarray, rows: int) -> float:
        """The sum of the last pair that a heap takes, nearest first, until the cells taken hold ``rows`` rows; a and b: distances of the halves."""
        by_a, by_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        da, db = a[by_a].tolist(), b[by_b].tolist()
        heap, held, at, seen = [(da[0] + db[0], 0, 0)], 0, 0.0, {(0, 0)}
        while heap and held < rows:
            at, i, j = heapq.heappop(heap)
            held += int(self.counts[by_a[i], by_b[j]])
            for x in ((i + 1, j), (i, j + 1)):
                if x[0] < len(da) and x[1] < len(db) and x not in seen:
                    seen.add(x)
                    heapq.heappush(heap, (da[x[0]] + db[x[1]], *x))
        return at


def centroids_for(n: int) -> int:
    """Centroids of each half for n rows: a power of two near the root of n / 4, from 16 to 512."""
    return int(min(512, max(16, 2 ** round(np.log2(max(n, 1) / 4) / 2))))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and x (array<double>) of the rows that take part: with an id, of the width of the smallest id's vector, finite and not zero."""
    x = F.col(vector_col).cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).where(F.col(id_col).isNotNull() & F.coalesce(fine, F.lit(False)))
    first = rows.select("id", F.size("x").alias("size")).orderBy("id", "size").limit(1).collect()
    return rows.where(F.size("x") == (first[0]["size"] if first else 0))


def distinct_vectors(rows: DataFrame, ids: int) -> DataFrame:
    """x and its ``ids`` smallest ids, for each distinct vector. The limit holds before rows are shuffled, so copies do not meet."""
    order = Window.partitionBy("h", "x").orderBy("id")
    # equal rows are one; ranks up to a limit are cut in the tasks that read the rows
    ranked = rows.withColumn("h", F.xxhash64("x")).withColumn("k", F.dense_rank().over(order)).where(F.col("k") <= ids)
    return ranked.groupBy("h", "x").agg(F.array_sort(F.collect_set("id")).alias("ids")).select("x", "ids")


def fit(entries: DataFrame, n: int, wanted: int, recall: float, sample: int = SAMPLE) -> Grid:
    """Centroids and margin from a sample of about ``sample`` rows (all, if fewer) by hashes of their vectors; the driver fits them."""
    pick = F.pmod(F.xxhash64(F.lit("sample"), "x"), F.lit(1 << 32)) < int(min(1.0, sample / max(n, 1)) * (1 << 32))
    x = np.array([r["x"] for r in entries.where(pick).select("x").limit(2 * sample).collect()])
    if not len(x):
        x = np.array([r["x"] for r in entries.select("x").limit(1).collect()])
    x = x[np.lexsort(x.T[::-1])]
    x = x[np.random.default_rng(7).permutation(len(x))]  # rows of a sorted table in a repeatable order
    half, k = (x.shape[1] + 1) // 2, min(centroids_for(n), len(x))
    grid = Grid(kmeans(x[:, :half], k), kmeans(x[:, half:], k) if x.shape[1] > 1 else np.zeros((1, 0)))
    asked, (i, j) = x[:512], grid.cells(x)
    over = []
    for q in range(len(asked)):
        d = squares(asked[q : q + 1], x)[0]
        d[q] = np.inf
        near = np.argpartition(d, min(wanted, len(d) - 1))[:wanted]
        a, b = grid.sums(asked[q : q + 1])
        over.append((a[0][i[near]] + b[0][j[near]] - d[near])[np.isfinite(d[near])])
    over = np.concatenate(over) if over else np.zeros(0)
    grid.margin = float(np.quantile(over, recall)) if len(over) else 0.0
    return grid


def placed(entries: DataFrame, grid: Grid) -> DataFrame:
    """entries with i and j, the centroids of either half."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                x = b.column("x").flatten().to_numpy().reshape(b.num_rows, -1)
                i, j = grid.cells(x)
                yield pa.RecordBatch.from_arrays([b.column("x"), b.column("ids"), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32))], ["x", "ids", "i", "j"])

    return entries.mapInArrow(run, "x array<double>, ids array<long>, i int, j int")


def reached(queries: DataFrame, grid: Grid, first: int) -> DataFrame:
    """queries (id, x) with reach: the sum up to which the first pass takes cells."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                a, c = grid.sums(b.column("x").flatten().to_numpy().reshape(b.num_rows, -1))
                reach = [grid.reach(p, q, first) for p, q in zip(a, c, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("x"), pa.array(reach)], ["id", "x", "reach"])

    return queries.mapInArrow(run, "id long, x array<double>, reach double")


def probe(queries: DataFrame, entries: DataFrame, grid: Grid, n_queries: int, wanted: int) -> DataFrame:
    """query_id, x (the query), score, vec_id: the ``wanted`` nearest of all rows in cells whose sum is at most the query's reach.

    entries: x, ids, i, j. A row's ids number wanted + 1 at most, so a query that finds itself still has all it wants.
    """
    spark, n = queries.sparkSession, int(grid.counts.sum())
    of = grid.counts.sum(1)
    size = int(min(BLOCK, max(512, n // 512)))
    row_blocks, query_blocks = -(-of // size), max(1, -(-n_queries // BLOCK))
    blocks = F.get(F.lit(row_blocks.tolist()).cast("array<long>"), F.col("i"))
    rows = entries.select("i", F.pmod(F.xxhash64("x"), blocks).alias("rb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))).alias("qb"), "j", "x", "ids")

    def spread(batches) -> Iterator:
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            a, c = grid.sums(b.column("x").flatten().to_numpy().reshape(b.num_rows, -1))
            # regions whose nearest filled cell is within reach
            least = np.array([np.where(grid.counts[i] > 0, c, np.inf).min(1) for i in range(len(of))]).T
            row, i = np.nonzero(a + least <= b.column("reach").to_numpy()[:, None])
            kept = b.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(i.astype(np.int32))], [*kept.schema.names, "i"])

    visits = queries.select("id", "x", "reach").mapInArrow(spread, "id long, x array<double>, reach double, i int")
    visits = visits.withColumn("rb", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).withColumn("qb", F.pmod(F.xxhash64("id", "x"), F.lit(query_blocks)))

    def ranked(asked, found):
        import pyarrow as pa

        schema = pa.schema([("query_id", pa.int64()), ("x", pa.list_(pa.float64())), ("score", pa.float64()), ("vec_id", pa.int64())])
        if not asked.num_rows or not found.num_rows:
            return schema.empty_table()
        matrix = lambda t: t.column("x").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        x, ids, j = matrix(found), found.column("ids").to_pylist(), found.column("j").to_numpy()
        region, q, out = asked.column("i")[0].as_py(), matrix(asked), []
        own, reach = asked.column("id").to_pylist(), asked.column("reach").to_numpy()
        for s in range(0, len(q), 256):
            some = q[s : s + 256]
            a, c = grid.sums(some)
            d = np.where((a[:, region, None] + c <= reach[s : s + 256, None])[:, j], squares(some, x), np.inf)
            keep = min(wanted + 1, d.shape[1])
            last = np.partition(d, keep - 1, 1)[:, keep - 1]
            # rounding of the product: whatever might tie with the last is looked at exactly
            slack = 1e-9 * (1.0 + (some * some).sum(1) + np.where(np.isfinite(last), last, 0.0))
            for r in range(len(some)):
                near = np.flatnonzero(np.isfinite(d[r]) & (d[r] <= last[r] + slack[r]))
                score = np.sqrt(((x[near] - some[r]) ** 2).sum(1))
                best = sorted((t, v) for t, k in zip(score.tolist(), near.tolist(), strict=True) for v in ids[k] if v != own[s + r])[:wanted]
                out += [(s + r, t, v) for t, v in best]
        at = pa.array([o[0] for o in out], pa.int64())
        return pa.Table.from_arrays([asked.column("id").take(at), asked.column("x").take(at).cast(schema.field("x").type), pa.array([o[1] for o in out], pa.float64()), pa.array([o[2] for o in out], pa.int64())], schema=schema)

    keys = ("i", "rb", "qb")
    pairs = visits.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(ranked, "query_id long, x array<double>, score double, vec_id long")
    order = Window.partitionBy("query_id", "x").orderBy("score", "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= wanted)


def search(vectors: DataFrame, queries: DataFrame, wanted: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", first: int = 512, recall: float = 0.95, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score of the ``wanted`` nearest rows found for each row of queries (same columns as vectors).

    A row that has the query's id is never its neighbour. Vectors take no part if they are null, zero, hold null or non-finite
    components, have no id, or another width than that of the smallest id. Equal rows count once; queries that share an id but
    not a vector each get their own ranks. Ties go to the smaller id. Fewer rows than wanted give as many; no rows
    give no rows. Other columns are not read. ``first``: rows in the cells of the first pass at least. ``recall``: the share of sample neighbours that the margin covers.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    entries = materialize(distinct_vectors(usable(vectors, id_col, vector_col), wanted + 1))
    n = entries.count()
    if not n:
        return spark.createDataFrame([], schema)
    grid = fit(entries, n, wanted, recall, sample)
    before, entries = entries, materialize(placed(entries, grid))
    discard(before)
    width = grid.half + grid.right.shape[1]
    asked = usable(queries, id_col, vector_col).where(F.size("x") == width).dropDuplicates(["id", "x"])
    # cells number 2**18 at most
    for r in entries.groupBy("i", "j").count().collect():
        grid.counts[r["i"], r["j"]] = r["count"]
    asked = materialize(reached(asked, grid, first))
    n_queries = asked.count()
    near = materialize(probe(asked, entries, grid, n_queries, wanted))
    last = near.groupBy("query_id", "x").agg(F.max("score").alias("last"), F.count(F.lit(1)).alias("n"))
    margin = F.when(F.col("n") >= wanted, F.col("last") * F.col("last") + grid.margin).otherwise(float("inf"))
    # a query whose cells hold too few neighbours visits all
    wider = asked.join(last.withColumnRenamed("query_id", "id"), ["id", "x"], "left").select("id", "x", F.greatest("reach", F.coalesce(margin, F.lit(float("inf")))).alias("reach"))
    found = probe(materialize(wider), entries, grid, n_queries, wanted)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(rows, rows.where(F.col("vec_id") % 100 == 0))
