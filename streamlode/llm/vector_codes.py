"""Vector codes: product quantisation in whole numbers, with entries found by Exponion search.

Components become floor(scale * x), vectors are cut into even parts, and each part position has a codebook that a fixed count
of rounds moves to the means of what it is assigned. The search starts at the entry that a part had before, at
distance u. The nearest entry, or any that ties with it, lies within u of the part, so within 2u of that entry: of
its list of neighbour entries, sorted by distance, only those inside that radius are scanned, in steps that double. All
distances are squared and exact, ties go to the lower index, so the result is that of a full scan.

Rows with their entries are written after each round; the tasks sum the parts of each entry, so a round sends one row for each
entry and task, and at most entries x parts rows reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize, spread_join

#: Whole numbers beyond this size are not taken: squared distances stay below 2**63.
LARGEST = 1 << 28
#: Rows that a task gathers before it searches.
STEP = 16_384


def distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances (int64) of points and entries, both int64. By matrix product where doubles hold every number that occurs."""
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * points.shape[1] * most * most < 1 << 53:
        p, e = points.astype(float), entries.astype(float)
        return ((p * p).sum(1)[:, None] - 2.0 * (p @ e.T) + (e * e).sum(1)).astype(np.int64)
    out = np.zeros((len(points), len(entries)), np.int64)
    for i in range(points.shape[1]):
        out += (points[:, i, None] - entries[:, i]) ** 2
    return out


class Codebook:
    """The entries of one part position, and for each its neighbours by distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        between = distances(entries, entries)
        self.order = np.argsort(between, axis=1, kind="stable")
        self.apart = np.take_along_axis(between, self.order, 1)
        self.scanned = 0

    def nearest(self, points: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each point's nearest entry, ties to the lower index; start: an index for each."""
        found, error = np.empty(len(points), np.int64), np.empty(len(points), np.int64)
        by_start = np.argsort(start, kind="stable")
        edges = np.flatnonzero(np.diff(start[by_start], prepend=-1, append=len(self.entries)))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            rows = by_start[a:b]
            at = start[rows[0]]
            u = distances(points[rows], self.entries[at : at + 1])[:, 0]
            # squares: within 2u of the entry
            inside = np.searchsorted(self.apart[at], 4 * u, side="right")
            self.scanned += len(rows)
            steps = np.ceil(np.log2(inside)).astype(int)
            for step in np.unique(steps):
                some, ids = rows[steps == step], self.order[at, : 1 << step]
                d = distances(points[some], self.entries[ids])
                self.scanned += d.size if step else 0
                least = d.min(1)
                found[some] = np.where(d == least[:, None], ids, len(self.entries)).min(1)
                error[some] = least
        return found, error


def part_edges(width: int, parts: int) -> list[int]:
    """Where the parts begin, and the end: equal, or the first ones longer by one."""
    return [0, *np.cumsum([len(x) for x in np.array_split(np.arange(width), parts)]).tolist()]


def whole_numbers(vectors: DataFrame, vector_col: str, id_col: str, scale: int) -> DataFrame:
    """The kept rows with __x, the vector in whole numbers, in place of the vector. All have one width."""
    x = F.col(vector_col).cast("array<double>")
    whole = F.transform(x, lambda v: F.floor(v * scale))
    fits = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) * scale < LARGEST))
    kept = vectors.where(x.isNotNull() & F.coalesce(fits, F.lit(False)))
    first = kept.select(F.col(id_col).alias("id"), F.size(vector_col).alias("size")).orderBy(F.col("id").asc_nulls_last(), "size").limit(1).collect()
    kept = kept.where(F.size(vector_col) == (first[0]["size"] if first else 0))
    return kept.select(*(F.col(c) for c in vectors.columns if c != vector_col), whole.cast("array<int>").alias("__x"))


def gathered(batches) -> Iterator:
    """Arrow batches joined up to ``STEP`` rows or more, empty ones left out."""
    import pyarrow as pa

    held, n = [], 0
    for b in batches:
        held, n = [*held, b], n + b.num_rows
        if n >= STEP:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def assign(rows: DataFrame, books: list[np.ndarray], edges: list[int]) -> DataFrame:
    """rows with __at (the nearest entry of each part) and __error, searched from the entries of __at, or from the first."""
    names = [c for c in rows.columns if c not in ("__at", "__error")]
    schema = T.StructType([*(rows.schema[c] for c in names), T.StructField("__at", T.ArrayType(T.IntegerType())), T.StructField("__error", T.LongType())])
    had, parts = "__at" in rows.columns, len(books)

    def run(batches) -> Iterator:
        import pyarrow as pa

        tables = [Codebook(b) for b in books]
        for some in gathered(batches):
            x = some.column("__x").flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, -1).astype(np.int64)
            start = some.column("__at").flatten().to_numpy(zero_copy_only=False).reshape(-1, parts) if had else np.zeros((len(x), parts), int)
            pairs = [t.nearest(x[:, s:e], start[:, p]) for p, (t, s, e) in enumerate(zip(tables, edges[:-1], edges[1:], strict=True))]
            at = np.stack([f for f, _ in pairs], 1).astype(np.int32).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(at) + 1, parts, dtype=np.int32)), pa.array(at))
            error = pa.array(sum(e for _, e in pairs))
            yield pa.RecordBatch.from_arrays([*(some.column(c) for c in names), lists, error], [*names, "__at", "__error"])

    return rows.mapInArrow(run, schema)


def moved(assigned: DataFrame, books: list[np.ndarray], edges: list[int]) -> list[np.ndarray]:
    """Codebooks at the floor of the means; entries without parts stay. One row for each entry reaches the driver."""
    wide, parts = max(np.diff(edges)), len(books)
    sizes = [len(b) for b in books]

    def run(batches) -> Iterator:
        import pyarrow as pa

        n = [np.zeros(s, np.int64) for s in sizes]
        sums = [np.zeros((s, wide), np.int64) for s in sizes]
        for b in batches:
            x = b.column("__x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            at = b.column("__at").flatten().to_numpy(zero_copy_only=False).reshape(-1, parts)
            for p in range(parts):
                n[p] += np.bincount(at[:, p], minlength=sizes[p])
                np.add.at(sums[p][:, : edges[p + 1] - edges[p]], at[:, p], x[:, edges[p] : edges[p + 1]])
        rows = [(p, e, int(n[p][e]), sums[p][e].tolist()) for p in range(parts) for e in np.flatnonzero(n[p]).tolist()]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["part", "entry", "n", "sums"])

    partial = assigned.select("__x", "__at").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    total = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("sums", F.lit(i))) for i in range(wide))).alias("sums"))
    out = [b.copy() for b in books]
    for r in total.collect():
        p = r["part"]
        out[p][r["entry"]] = np.array(r["sums"][: edges[p + 1] - edges[p]], np.int64) // r["n"]
    return out


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> tuple[DataFrame, list[np.ndarray]]:
    """The kept rows and columns of vectors but the vector, plus code and error, and the codebooks.

    Dropped are vectors that are null or hold null, non-finite or too large (2**28 once scaled) components, and those of
    another width than the smallest kept id's. A width that the parts do not divide makes the first parts longer. The codebooks start as the parts of the
    smallest ids, null ids last and ties by vector; fewer rows give shorter codebooks. Repeated rows count as often as they
    occur. Input columns named like the new ones are replaced; no rows give no rows and empty codebooks.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    rows = materialize(whole_numbers(vectors.drop("code", "error"), vector_col, id_col, scale))
    first = np.array([r["__x"] for r in rows.select(id_col, "__x").orderBy(F.col(id_col).asc_nulls_last(), "__x").limit(entries).collect()], np.int64)
    edges = part_edges(first.shape[1] if first.size else 0, parts)
    books = [first[:, s:e] if first.size else np.zeros((0, 0), np.int64) for s, e in zip(edges[:-1], edges[1:], strict=True)]
    if not first.size:
        none = rows.drop("__x").withColumns({"code": F.lit("" if not len(first) else "00" * parts), "error": F.lit(0).cast("long")})
        return none, books
    for turn in range(rounds + 1):
        before, rows = rows, materialize(assign(rows, books, edges))
        discard(before)
        if turn < rounds:
            books = moved(rows, books, edges)
    code = F.concat(*(F.lower(F.lpad(F.hex(F.get("__at", F.lit(p)).cast("long")), 2, "0")) for p in range(parts)))
    return rows.withColumns({"code": code, "error": F.col("__error")}).drop("__x", "__at", "__error"), books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def with_group_error(coded: DataFrame, label_col: str = "label") -> DataFrame:
    """coded plus label_error, the error summed over equal labels (nulls are a group). Groups of many rows are spread over the tasks."""
    coded = coded.drop("label_error").withColumn("__label", F.coalesce(F.concat(F.lit("="), F.col(label_col).cast("string")), F.lit("null")))
    groups = materialize(coded.groupBy("__label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("__rows")))
    total = groups.agg(F.sum("__rows")).first()[0] or 0
    return spread_join(coded, groups, ["__label"], "__rows", total, F.xxhash64("code", "error").cast("string")).drop("__label", "__rows")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
    return with_group_error(coded).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def rounds_sql(rounds: int = 4, parts: int = 4) -> str:
    """k{r}: the codebooks after r rounds; a{r}: part p of each row with its entry under k{r}."""
    out = []
    for r in range(rounds + 1):
        out.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, p, x, arg_min(e, d * 256 + e) AS e, min(d) AS d FROM (SELECT v.vec_id, v.p, v.x, k.e, (v.s - 2 * list_inner_product(v.x, k.x) + k.s)::BIGINT AS d FROM pt v JOIN k{r} k USING (p)) GROUP BY ALL)""")
        if r < rounds:
            out.append(f"""k{r + 1} AS MATERIALIZED (SELECT p, e, x, list_inner_product(x, x) AS s FROM (SELECT k.p, k.e, coalesce(m.x, k.x) AS x FROM k{r} k LEFT JOIN
  (SELECT p, e, list(v ORDER BY i) AS x FROM (SELECT p, e, i, floor(sum(x[i]) / count(*)) AS v FROM a{r}, range(1, 17) t(i) GROUP BY p, e, i) GROUP BY p, e) m ON m.p = k.p AND m.e = k.e))""")
    return ",\n".join(out)


SQL = f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda v: floor(v::DOUBLE * 1024)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
pt AS MATERIALIZED (SELECT vec_id, p, x, list_inner_product(x, x) AS s FROM (SELECT vec_id, p, w[p * 16 + 1 : p * 16 + 16] AS x FROM kept, range(4) t(p))),
k0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x, s FROM pt QUALIFY e < 256),
{rounds_sql()},
coded AS (SELECT vec_id, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a4 GROUP BY vec_id),
book AS (SELECT sha256(string_agg(x[i]::BIGINT::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM k4, range(1, 17) t(i))
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), book
"""
