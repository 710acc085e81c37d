"""Quality classifier: a generalised additive model with pairwise interactions.

One pass over the whole texts gives each document a few numeric features. Shallow trees, boosted in turn
over the features and then over the strongest pairs of features, are summed into one lookup table for each
feature and pair. A score is the logistic function of a sum of table cells, taken for whole batches at once.

The tables are fitted on all labelled rows. Tasks sum gradients and curvatures of their rows by cells and by pairs of cells;
from these sums alone (their size does not depend on the rows) the driver boosts some rounds of trees, and then the sums are made anew.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import added, discard, materialize

NAMES = (
    "log_words", "word_length", "distinct_words", "top_word", "upper", "digits", "symbols", "bangs", "high_bytes",
    "repeated_lines", "line_words", "symbol_words", "short_words", "upper_words", "repeated_bigrams", "longest_word",
)


def measure(text: str | None) -> list[float]:
    """The features of a whole text, in the order of NAMES; a text without words has all zeros."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * len(NAMES)
    n = len(words)
    chars = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    solid = chars.sum() - chars[32] - chars[9:14].sum()
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in raw.split(b"\n") if x]
    letters = max(chars[65:91].sum() + chars[97:123].sum(), 1)
    symbols = chars[33:48].sum() + chars[58:65].sum() + chars[91:97].sum() + chars[123:127].sum()
    odd = sum(c for w, c in counts.items() if len(w) < 4 and not w.isalnum() and w.isascii())
    shouted = sum(c for w, c in counts.items() if len(w) > 1 and w.isupper())
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        np.log1p(n), lengths.mean(), len(counts) / n, max(counts.values()) / n, chars[65:91].sum() / letters, chars[48:58].sum() / solid, symbols / solid,
        chars[33] / solid, chars[128:].sum() / solid, 1 - len(set(lines)) / max(len(lines), 1), n / max(len(lines), 1), odd / n,
        (lengths <= 2).mean(), shouted / n, 1 - pairs / max(n - 1, 1), float(lengths.max()),
    ]


def measured(texts, rows: int = 250) -> Iterator[np.ndarray]:
    """The features of an Arrow array of texts, some rows at a time."""
    for at in range(0, max(len(texts), 1), rows):
        yield np.array([measure(t) for t in texts.slice(at, rows).to_pylist()], float).reshape(-1, len(NAMES))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and x (array of the features) for each row of docs."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            x = np.concatenate(list(measured(b.column(1))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(np.arange(0, x.size + 1, len(NAMES), dtype=np.int32), x.ravel())], ["doc_id", "x"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, x array<double>")


def numbers(x) -> np.ndarray:
    """An Arrow array of features as rows of an array."""
    return x.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))


@dataclass
class Model:
    """Bin edges and tables; ``pairs`` holds (i, j, table)."""

    bias: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for k, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += t[np.searchsorted(e, x[:, k])]
        for i, j, t in self.pairs:
            total += t[np.searchsorted(self.coarse[i], x[:, i]), np.searchsorted(self.coarse[j], x[:, j])]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def leaves(g: np.ndarray, h: np.ndarray, n: np.ndarray, splits: int = 3, least: int = 10) -> np.ndarray:
    """Newton steps of a tree of up to ``splits`` cuts over ordered bins with gradients g, curvatures h and n rows."""
    cuts, gain = [0, len(g)], lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 1)
    for _ in range(splits):
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a < 2:
                continue
            gs, hs, ns = np.cumsum(g[a:b]), np.cumsum(h[a:b]), np.cumsum(n[a:b])
            left = gs[:-1] ** 2 / (hs[:-1] + 1) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + 1) - gain(a, b)
            left[(ns[:-1] < least) | (ns[-1] - ns[:-1] < least)] = 0
            k = int(left.argmax())
            best = max(best, (float(left[k]), a + k + 1), key=lambda v: v[0])
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return out


#: Shares of a row are summed as multiples of 2**-24: whole numbers, whose sums do not depend on the order of rows.
UNIT = 1 << 24


def slopes(model: Model, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the slope of the log-likelihood at its score, and the curvature of the tightest parabola below it, in UNITs.

    A step up the parabola (Jaakkola and Jordan's bound) never lowers the likelihood.
    """
    raw = np.clip(model.raw(x), -30, 30)
    far = np.abs(raw) > 1e-3
    curve = np.where(far, np.tanh(raw / 2) / (2 * np.where(far, raw, 1)), 0.25)
    return np.rint((y - 1 / (1 + np.exp(-raw))) * UNIT), np.rint(curve * UNIT)


def fitted(rows: DataFrame, bins: int = 48, coarse: int = 8, rounds: int = 120, passes: int = 10, n_pairs: int = 6, rate: float = 0.1) -> Model:
    """Fit the tables to rows (x and y, 0 or 1); with one class or few rows the score is a constant.

    Edges are quantiles of all rows, right to a ten-thousandth of their count. ``rounds`` are made in ``passes`` over all rows; between
    passes slopes follow the steps by the curvatures, which are kept.
    """
    model, d = Model(), len(NAMES)
    probs = [k / bins for k in range(1, bins)] + [k / coarse for k in range(1, coarse)]
    quantiles = [F.percentile_approx(F.get("x", F.lit(k)), probs, 10_000) for k in range(d)]
    about = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones"), F.min("y").alias("low"), F.max("y").alias("high"), F.array(*quantiles).alias("q")).first()
    share = ((about["ones"] or 0) + 1) / (about["n"] + 2)
    model.bias = float(np.log(share / (1 - share)))
    if about["n"] < 20 or about["low"] == about["high"]:
        return model
    model.edges = [np.unique(q[: bins - 1]) for q in about["q"]]
    model.coarse = [np.unique(q[bins - 1 :]) for q in about["q"]]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]

    def cells(x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, k]) for k, e in enumerate(model.edges)]

    def pair_cells(x: np.ndarray, pairs: list[tuple[int, int]]) -> list[np.ndarray]:
        rough = [np.searchsorted(e, x[:, k]) for k, e in enumerate(model.coarse)]
        return [rough[i] * (len(model.coarse[j]) + 1) + rough[j] for i, j in pairs]

    def surveyed(cells, sizes: list[int], crossed: bool = True) -> tuple[list, dict]:
        """Over all rows, for each kind of cells: slopes, curvatures and rows by cell; and curvatures by pairs of cells of two kinds."""

        def sums(x, y):
            g, h = slopes(model, x, y)
            found, m = cells(x), sizes
            out = {(k, k): np.concatenate([np.bincount(c, v, m[k]) for v in (g, h, None)]) for k, c in enumerate(found)}
            if crossed:
                out |= {(k, j): np.bincount(found[k] * m[j] + found[j], h, m[k] * m[j]) for k in range(len(m)) for j in range(k)}
            return {k * len(m) + j: v for (k, j), v in out.items()}

        got = added(rows.select("x", "y"), lambda b: sums(numbers(b.column(0)), b.column(1).to_numpy(zero_copy_only=False).astype(float)))
        own = [got[k * len(sizes) + k].reshape(3, -1) / [[UNIT], [UNIT], [1]] for k in range(len(sizes))]
        cross = {}
        for k in range(len(sizes) if crossed else 0):
            for j in range(k):
                cross[k, j] = got[k * len(sizes) + j].reshape(sizes[k], sizes[j]) / UNIT
                cross[j, k] = cross[k, j].T
        return own, cross

    def boost(tables, cells, sizes, step_of, rounds: int, passes: int):
        for r in range(passes):
            own, cross = surveyed(cells, sizes)
            for _ in range(rounds * (r + 1) // passes - rounds * r // passes):
                for k, table in enumerate(tables):
                    g, h, n = own[k]
                    step = rate * step_of(k, g, h, n)
                    table += step.reshape(table.shape)
                    g -= h * step
                    for j in range(len(tables)):
                        if j != k:
                            own[j][0] -= cross[j, k] @ step

    boost(model.tables, cells, [len(t) for t in model.tables], lambda k, g, h, n: leaves(g, h, n), rounds, passes)
    every = [(i, j) for i in range(d) for j in range(i)]
    size = lambda i, j: (len(model.coarse[i]) + 1) * (len(model.coarse[j]) + 1)
    own, _ = surveyed(lambda x: pair_cells(x, every), [size(*p) for p in every], crossed=False)
    strength = [((g**2 / (h + 5)).sum(), *p) for (g, h, _), p in zip(own, every, strict=True)]
    picked = [(i, j) for _, i, j in sorted(strength)[::-1][:n_pairs]]
    model.pairs = [(i, j, np.zeros((len(model.coarse[i]) + 1, len(model.coarse[j]) + 1))) for i, j in picked]
    shapes = [table.shape for _, _, table in model.pairs]
    boost([t for _, _, t in model.pairs], lambda x: pair_cells(x, picked), [size(*p) for p in picked], lambda k, g, h, n: crossed_cuts(g.reshape(shapes[k]), h.reshape(shapes[k])).ravel(), rounds // 3, max(1, passes // 3))
    return model


def crossed_cuts(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Newton steps of a tree of one cut along each axis of a table, the second chosen apart on either side of the first."""
    best, step = 0.0, np.zeros(g.shape)
    for axis in (0, 1):
        a, b = (g, h) if axis == 0 else (g.T, h.T)
        for c in range(1, a.shape[0]):
            tree, gain = np.zeros(a.shape), 0.0
            for part in (slice(0, c), slice(c, None)):
                gs, hs = a[part].sum(axis=0), b[part].sum(axis=0)
                cg, ch = np.cumsum(gs), np.cumsum(hs)
                left = cg[:-1] ** 2 / (ch[:-1] + 5) + (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + 5)
                k = int(left.argmax()) if len(left) else 0
                gain += float(left[k]) if len(left) else cg[-1] ** 2 / (ch[-1] + 5)
                tree[part, : k + 1] = cg[k] / (ch[k] + 5)
                tree[part, k + 1 :] = (cg[-1] - cg[k]) / (ch[-1] - ch[k] + 5)
            if gain > best:
                best, step = gain, tree if axis == 0 else tree.T
    return step


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(modulus)) == remainder


def training_ids(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, max_rows: int) -> DataFrame:
    """doc_id and y of at most max_rows documents with a label that are not held out, those with the smallest hashes of their ids.

    A document that is labelled twice takes the larger label; ids without a label or null ids are left out.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    ids = docs.select("doc_id").where(~held_out("doc_id", modulus, remainder)).join(known, "doc_id").distinct()
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


def learn(docs: DataFrame, labels: DataFrame, max_rows: int | None = None) -> Model:
    """The model fitted on the labelled rows of docs (doc_id, text) that are not held out: all, or at most max_rows of the smallest hashes of ids."""
    docs = docs.where(F.col("doc_id").isNotNull() & ~held_out("doc_id", 4, 2))
    return learned(features(docs), labels, max_rows)


def learned(rows: DataFrame, labels: DataFrame, max_rows: int | None = None) -> Model:
    """As ``learn``, from rows of doc_id and x. Of rows that share an id, the one with the least features counts; one that is labelled twice has the larger label."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    found = rows.join(known, "doc_id").groupBy("doc_id").agg(F.min("x").alias("x"), F.max("y").alias("y"))
    if max_rows is not None:
        found = found.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    found = materialize(found.select("x", "y"))  # a few numbers a row
    model = fitted(found)
    discard(found)
    return model


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_rows: int | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs (doc_id, text); other columns are left out.

    Null and empty texts have zeros as features and get a score like others. Repeated rows get equal
    scores. Without labels every score is 0.5. No rows give no rows. Texts are measured once, for the model and the scores.
    """
    measures = materialize(features(docs))
    model = learned(measures.where(F.col("doc_id").isNotNull() & ~held_out("doc_id", 4, 2)), labels, max_rows)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(model.score(numbers(b.column(2))))], ["doc_id", "held_out", "score"])

    rows = measures.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "x").mapInArrow(run, "doc_id long, held_out boolean, score double")
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_rows: int | None = None) -> DataFrame:
    """The rows of docs whose score reaches the threshold; columns as in docs.

    Each row is judged by its own text in the pass that scores it: null and repeated ids make no difference.
    """
    model = learn(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), labels, max_rows)
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            done = 0
            for x in measured(b.column(at)):  # handed on in as small parts
                yield b.slice(done, len(x)).filter(pa.array(model.score(x) >= threshold))
                done += len(x)

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scored(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
