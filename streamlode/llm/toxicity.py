"""Toxicity by class-conditional Kneser-Ney models.

Two models, one of toxic and one of ordinary labelled documents, count in how many different left contexts
each word stands (continuation counts), discount these by the counts of counts, and share what they back off to: the
continuation counts over all documents, labelled or not, in which words that no sampled document has are one word.

How much a model trusts its own estimate of a word grows smoothly with the evidence that the classes differ in it: z, by how many
standard deviations its share of toxic documents is off the expected one, gives the weight (z**2 / (z**2 + s**2))**2; what the weights leave over goes to
the shared counts. So a rare expression, which one class alone saw by chance, falls back to nearly the same probability in both, and no
word is left out. The strength s is the one under which labelled documents that the counts have not seen are likeliest.

A document is scored by the difference of its two log-likelihoods, normalised by length: over the whole text and
over its most toxic stretch of ``SPAN`` words, so that a long text does not dilute a short insult. A logistic
function of both, fitted on labelled documents that the counts have not seen, gives the score.

Class counts come from a bounded sample of labelled rows (``max_rows`` and ``max_bytes``, those with the smallest hashes of
their ids), so the tables that are broadcast are bounded too; the backoff counts come from every document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Words, byte_values, discard, materialize, mix64, tokenized
from .quality import held_out, training_ids

SPAN = 12
#: Strengths of the evidence weights to choose from.
STRENGTHS = (2.0, 3.0, 4.5, 6.0, 8.0, 12.0)
#: Words without case; ASCII punctuation separates them.
FOLDED = byte_values(lower=True, separators=bytes(c for c in range(128) if not chr(c).isalnum()))


def pair_keys(words: np.ndarray) -> np.ndarray:
    """Keys of the bigrams; the first word follows a start mark."""
    left = np.empty_like(words)
    left[:1], left[1:] = 0, words[:-1]
    return mix64(left * np.uint64(0x9E3779B97F4A7C15) + words)


@dataclass
class Model:
    """Log-likelihoods of words (sorted hashes) in ordinary and toxic documents, and of one that is not among them."""

    words: np.ndarray
    ordinary: np.ndarray
    toxic: np.ndarray
    unknown: tuple[float, float] = (0.0, 0.0)
    calibration: tuple[float, ...] = (0.0, 0.0, 0.0)

    def ratios(self, hashes: np.ndarray) -> np.ndarray:
        """Toxic over ordinary, for each word."""
        if not len(self.words):
            return np.zeros(len(hashes))
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, (self.toxic - self.ordinary)[at], self.unknown[1] - self.unknown[0])

    def measures(self, words: Words) -> np.ndarray:
        """For each text: the ratio per word over its most toxic span, and over the whole text times the root of its length in spans."""
        out = np.zeros((len(words), 2))
        sums = np.concatenate([[0.0], np.cumsum(self.ratios(words.hashes))])
        for k, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
            if a < b:
                own, span = sums[a : b + 1] - sums[a], min(SPAN, b - a)
                out[k] = (own[span:] - own[:-span]).max() / SPAN, own[-1] / (b - a) * np.sqrt(max((b - a) / SPAN, 1.0))
        return out

    def scores(self, measures: np.ndarray) -> np.ndarray:
        a, b, c = self.calibration
        return 1 / (1 + np.exp(-np.clip(a * measures[:, 0] + b * measures[:, 1] + c, -30, 30)))


def discount(n: np.ndarray) -> float:
    """The share of a count that Kneser-Ney takes away, by how many words have the counts 1 and 2; 1 if none has 2."""
    ones, twos = int((n == 1).sum()), int((n == 2).sum())
    return ones / (ones + 2 * twos) if ones and twos else 1.0


def evidence(d0: np.ndarray, d1: np.ndarray, docs: tuple[int, int]) -> np.ndarray:
    """By how many standard deviations the toxic documents with a word are off what its documents of both classes let expect; docs: of each class."""
    total = max(docs[0] + docs[1], 1)
    share = (d0 + d1) / total
    spread = np.sqrt(docs[1] * share * (1 - share) * docs[0] / total)
    return np.divide(d1 - docs[1] * share, spread, out=np.zeros(len(share)), where=spread > 0)


def estimate(words, shared_total: float, docs: tuple[int, int], strength: float) -> Model:
    """words: a frame of w (by unsigned value), n0 and n1 (left contexts by class), d0 and d1 (documents by class), shared (contexts in all documents).

    With the one word that stands for all others, the probabilities of either class sum to 1.
    """
    ids = words["w"].to_numpy(np.int64).view(np.uint64)
    base = np.maximum(words["shared"].to_numpy(float), 1)
    whole = max(shared_total, base.sum() + 1)
    base, other = base / whole, 1 - base.sum() / whole
    z2 = evidence(words["d0"].to_numpy(float), words["d1"].to_numpy(float), docs) ** 2
    trust = (z2 / (z2 + strength**2)) ** 2
    spare = (1 - trust) * base
    logs, unknown = [], []
    for c in ("n0", "n1"):
        n = words[c].to_numpy(float)
        total, d = max(n.sum(), 1), discount(n)
        own = np.maximum(n - d, 0) / total + d * (n > 0).sum() / total * base
        left = (1 - (trust * own).sum()) / (spare.sum() + other)
        logs.append(np.log(trust * own + left * spare))
        unknown.append(float(np.log(left * other)))
    return Model(ids, logs[0], logs[1], (unknown[0], unknown[1]))


def calibrate(model: Model, measures: np.ndarray, y: np.ndarray) -> Model:
    """Fit the logistic function by Newton's method; with one class the score is that class's share."""
    share = (y.sum() + 1) / (len(y) + 2)
    beta = np.array([0.0, 0.0, np.log(share / (1 - share))])
    if len(y) and y.min() != y.max():
        x = np.column_stack([measures, np.ones(len(y))])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            h = (x * (p * (1 - p))[:, None]).T @ x + 0.02 * np.eye(3)
            beta = beta + np.clip(np.linalg.solve(h, x.T @ (y - p) - 0.02 * beta), -5, 5)
    model.calibration = tuple(map(float, beta))
    return model


def loss(model: Model, measures: np.ndarray, y: np.ndarray) -> float:
    p = np.clip(model.scores(measures), 1e-9, 1 - 1e-9)
    return float(-np.where(y == 1, np.log(p), np.log(1 - p)).sum())


def counted(rows: DataFrame) -> DataFrame:
    """w, n0 and n1: in how many different left contexts a word stands in the documents of each class, d0 and d1: in how many documents (rows: text, y)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for k, words in tokenized(batch.column(0), FOLDED):
                sizes = np.diff(words.first)
                keys, inside = pair_keys(words.hashes), np.ones(len(words.hashes), bool)
                inside[words.first[:-1][sizes > 0]] = False
                of = np.repeat(y[k : k + len(words)], sizes)
                for c in (0, 1):
                    some = inside & (of == c)
                    found, at = np.unique(keys[some], return_index=True)
                    columns = (words.hashes[some][at].view(np.int64), found.view(np.int64), np.full(len(found), c, np.int32))
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["w", "key", "y"])

    def documents(batches):
        import pyarrow as pa

        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for k, words in tokenized(batch.column(0), FOLDED):
                own = [np.unique(words.of(i)) for i in range(len(words))]
                for c in (0, 1):
                    some = [w for w, of in zip(own, y[k : k + len(words)], strict=True) if of == c]
                    if some:
                        found, n = np.unique(np.concatenate(some), return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n * (1 - c)), pa.array(n * c)], ["w", "d0", "d1"])

    contexts = rows.select("text", "y").mapInArrow(run, "w long, key long, y int").distinct()
    contexts = contexts.groupBy("w").agg(F.sum(1 - F.col("y")).alias("n0"), F.sum("y").alias("n1"))
    docs = rows.select("text", "y").mapInArrow(documents, "w long, d0 long, d1 long").groupBy("w").agg(F.sum("d0").alias("d0"), F.sum("d1").alias("d1"))
    return contexts.join(docs, "w")


def packed(values: np.ndarray) -> bytes:
    """Sorted integers as compressed differences, byte by byte from the lowest."""
    return zlib.compress(np.diff(values, prepend=0).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").reshape(-1).astype(np.int64))


def continuations(docs: DataFrame, vocabulary: np.ndarray, bucket_bytes: int = 12_000_000, most_words: int = 2_000_000) -> tuple[np.ndarray, int]:
    """How many different words stand before each word of the vocabulary (sorted hashes) in the corpus, and before all words in sum.

    After a word, all words outside the vocabulary are one word. A task drops the repeats of every ``most_words`` pairs and deals the pairs
    to buckets; a bucket, whose pairs come from about ``bucket_bytes`` of text, drops the repeats of all tasks.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, width = max(12, -(-size // bucket_bytes)), len(vocabulary) + 1  # below 2**31: pairs fit in 64 bits
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # bounded by max_rows and max_bytes

    def run(batches) -> Iterator:
        import pyarrow as pa

        vocabulary = shared.value

        def flush(held):
            pairs = np.unique(np.concatenate(held))
            bucket = pairs % buckets
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
            pairs = pairs[order] // buckets
            some = [k for k in range(buckets) if ends[k] < ends[k + 1]]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([packed(pairs[ends[k] : ends[k + 1]]) for k in some], pa.binary())], ["bucket", "pairs"])

        held, n = [], 0
        for batch in batches:
            for _, words in tokenized(batch.column(0), FOLDED):
                codes = np.full(len(words.hashes), len(vocabulary), np.int64)
                if len(vocabulary):
                    at = np.minimum(np.searchsorted(vocabulary, words.hashes), len(vocabulary) - 1)
                    codes = np.where(vocabulary[at] == words.hashes, at, len(vocabulary))
                inside = np.ones(len(codes), bool)
                inside[words.first[:-1][np.diff(words.first) > 0]] = False
                left = (words.hashes & np.uint64(0xFFFFFFFF)).astype(np.int64)  # 32 bits tell contexts apart
                held.append(np.unique((np.append(0, left[:-1])[: len(codes)] * width + codes)[inside]))
                n += len(held[-1])
                if n > most_words:
                    yield flush(held)
                    held, n = [], 0
        if held:
            yield flush(held)

    def count(frame):
        import pandas as pd

        bucket = int(frame["bucket"].iloc[0])
        pairs = np.unique(np.concatenate([unpacked(x) for x in frame["pairs"]])) * buckets + bucket
        code, n = np.unique(pairs % width, return_counts=True)
        return pd.DataFrame({"code": code.astype(np.int32), "n": n})

    dealt = docs.select("text").mapInArrow(run, "bucket int, pairs binary")
    found = dealt.groupBy("bucket").applyInPandas(count, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(width, np.int64)
    counts[found["code"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    shared.unpersist()
    return counts[:-1], int(counts.sum())


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, max_bytes: int = 100_000_000) -> Model:
    """The calibrated model. One in four of the sampled rows chooses the strength and calibrates models that the others made; then all are counted.

    Of rows that share an id, the one with the shortest text counts. The sample ends before its texts pass max_bytes.
    """
    ids = materialize(training_ids(docs, labels, "toxic", 3, 1, max_rows))  # at most max_rows rows
    rows = docs.withColumn("row", F.xxhash64("text"))
    sizes = rows.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct(F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"), "row")).alias("one"))
    upto = F.sum("one.bytes").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    picked = materialize(sizes.withColumn("upto", upto).where(F.col("upto") <= max_bytes).select("doc_id", "y", "one.row"))
    sample = rows.join(F.broadcast(picked), ["doc_id", "row"]).dropDuplicates(["doc_id"]).withColumn("calibrates", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(4)) == 0)
    sample = materialize(sample)
    # counts of all sampled rows, and of those that do not calibrate: words are those of all
    names = ("n0", "n1", "d0", "d1")
    part = counted(sample.where("not calibrates")).select("w", *(F.col(c).alias(f"{c}_seen") for c in names))
    both = counted(sample).join(part, "w", "left").fillna(0).select("w", *(F.col(c).cast("int").alias(c) for c in (*names, *(f"{c}_seen" for c in names))))
    docs_of = {(r["calibrates"], r["y"]): r["count"] for r in sample.groupBy("calibrates", "y").count().collect()}
    docs_seen = tuple(docs_of.get((False, y), 0) for y in (0, 1))
    words = both.toArrow().to_pandas(split_blocks=True, self_destruct=True)  # bounded by max_rows and max_bytes
    words = words.iloc[np.argsort(words["w"].to_numpy(np.int64).view(np.uint64))]
    words["shared"], total = continuations(docs, words["w"].to_numpy(np.int64).view(np.uint64))
    seen = words[["w", "shared"]].assign(**{c: words[f"{c}_seen"] for c in names})
    vocabulary, models = words["w"].to_numpy(np.int64).view(np.uint64).copy(), []
    for strength in STRENGTHS:
        m = estimate(seen, float(total), docs_seen, strength)
        # what measures need: one set of words, and the ratios alone in single precision
        models.append(Model(vocabulary, np.zeros(1, np.float32), (m.toxic - m.ordinary).astype(np.float32), (0.0, m.unknown[1] - m.unknown[0])))

    def measure(batches):
        import pyarrow as pa

        for batch in batches:
            for k, words in tokenized(batch.column(0), FOLDED):
                found = np.hstack([m.measures(words) for m in models])
                yield pa.RecordBatch.from_arrays([pa.array(found.tolist(), pa.list_(pa.float64())), batch.column(1)[k : k + len(words)]], ["found", "y"])

    known = sample.where("calibrates").select("text", "y").mapInArrow(measure, "found array<double>, y int").orderBy("found", "y").toPandas()
    discard(ids, picked, sample)
    found, y = np.array(known["found"].tolist(), float).reshape(-1, len(STRENGTHS), 2), known["y"].to_numpy(float)
    for k, m in enumerate(models):
        calibrate(m, found[:, k], y)
    best = int(np.argmin([loss(m, found[:, k], y) for k, m in enumerate(models)]))
    model = estimate(words, float(total), tuple(n + docs_of.get((True, y), 0) for y, n in enumerate(docs_seen)), STRENGTHS[best])
    model.calibration = models[best].calibration
    return model


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_rows: int = 12_000, max_bytes: int = 100_000_000) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs (doc_id, text); other columns are left out.

    Texts without words, null ones included, get the score of a text that says nothing. Repeated rows get
    equal scores. Without labels every score is 0.5. No rows give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    model = learn(docs, labels, max_rows, max_bytes)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k, words in tokenized(batch.column(2), FOLDED):
                rows = batch.slice(k, len(words))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(model.scores(model.measures(words)))], ["doc_id", "held_out", "score"])

    rows = docs.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double")
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scored(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
