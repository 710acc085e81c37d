"""Near-duplicates by b-bit MinHash.

One pass over the texts makes, for each document, the count of its distinct word shingles, a digest of its
words, 32 band keys of 4 minima each and a signature that keeps the low 4 bits of all 128 minima.
Documents with equal words form a class; only its smallest id goes on. Representatives that share a band
key are candidates. The collision-corrected similarity, from bit counts of packed signatures, drops those
that cannot be near; shared shingles of the full sets confirm the rest.

Buckets are not expanded into pairs. First each member is compared with the smallest id of its bucket; the
confirmed links join most buckets into one component. Only buckets that still hold several components are
compared further, and only across components: members outside of the largest component against all, pair
by pair in small buckets and block by block in large ones, which emit confirmed links only. So no candidate
link between components is lost. A pair at the threshold shares a band with probability 1 - (1 - 0.75**4)**32 > 0.99999.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, byte_values, find_words, gram_hashes, materialize, mix64, run_sums, spread_join, tokenized
from .components import components

N_HASHES, N_BANDS, LOW_BITS, SHINGLE = 128, 32, 4, 5
#: Buckets of up to so many documents are compared pair by pair, larger ones in blocks.
SMALL = 64
#: Words of texts with A-Z lower-cased.
LOWER = byte_values(lower=True)
FEATURES = "doc_id long, n_shingles long, d1 long, d2 long, signature array<long>, bands array<long>"


def shingle_sets(words: Words, n: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles; shorter texts are one shingle, those without words none."""
    grams = gram_hashes(words.hashes, n)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= n:
            found = np.sort(grams[a : b - n + 1])
            yield found[np.append(True, found[1:] != found[:-1])]
        elif b > a:
            yield gram_hashes(np.append(words.hashes[a:b], np.uint64(b - a)), b - a + 1)
        else:
            yield np.empty(0, np.uint64)


def shingles(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return next(shingle_sets(find_words(data, np.array([0, len(data)]), LOWER)))


def coefficients(k: int) -> tuple[np.ndarray, np.ndarray]:
    """k odd multipliers and k offsets, the same in every task."""
    x = mix64(np.arange(1, 2 * k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    return (x[:k] | np.uint64(1)).astype(np.uint32), x[k:].astype(np.uint32)


def minima(sets: list[np.ndarray], k: int = N_HASHES, rows: int = 1024) -> np.ndarray:
    """For non-empty sets: an array (sets, k) of 32-bit minima."""
    mul, add = coefficients(k)
    out, held = np.empty((len(sets), k), np.uint32), np.empty((rows, k), np.uint32)
    for i, s in enumerate(sets):
        x = (s >> np.uint64(32)).astype(np.uint32)[:, None]
        for at in range(0, len(x), rows):
            some = x[at : at + rows]
            part = np.multiply(some, mul, out=held[: len(some)])
            part += add
            low = part.min(axis=0)
            out[i] = low if not at else np.minimum(out[i], low)
    return out


def packed(mins: np.ndarray, bits: int = LOW_BITS) -> np.ndarray:
    """The low bits of the minima, packed into 64-bit words."""
    lanes = 64 // bits
    low = (mins & np.uint32((1 << bits) - 1)).astype(np.uint64).reshape(len(mins), -1, lanes)
    return (low << (np.arange(lanes, dtype=np.uint64) * np.uint64(bits))).sum(axis=2, dtype=np.uint64).view(np.int64)


def band_keys(mins: np.ndarray, bands: int = N_BANDS) -> np.ndarray:
    part = mins.reshape(len(mins), bands, -1).astype(np.uint64)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), part.shape[:2]).copy()
    for j in range(part.shape[2]):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + part[:, :, j])
    return key.view(np.int64)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row of FEATURES for each row of docs: d1 and d2 are a 128-bit digest of the words; without words: 0 shingles and nulls."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k, words in tokenized(batch.column(1), LOWER):
                sets = list(shingle_sets(words))
                sizes = np.array([len(s) for s in sets])
                full = np.flatnonzero(sizes)
                lists, digests, none = [], [], sizes == 0
                mins = minima([sets[i] for i in full])
                for found in (packed(mins), band_keys(mins)):
                    ends = np.concatenate([[0], np.cumsum(~none) * found.shape[1]]).astype(np.int32)
                    lists.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(found.reshape(-1)), mask=pa.array(none)))
                for values in (words.hashes, mix64(words.hashes)):
                    made = np.zeros(len(sets), np.int64)
                    made[full] = mix64(run_sums(values, words.first[full], words.first[full + 1])).view(np.int64) if len(full) else 0
                    digests.append(pa.array(made, mask=none))
                yield pa.RecordBatch.from_arrays([batch.column(0)[k : k + len(sets)], pa.array(sizes, pa.int64()), *digests, *lists], [c.split()[0] for c in FEATURES.split(", ")])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, FEATURES)


def estimate(a: Column, b: Column, k: int = N_HASHES, bits: int = LOW_BITS) -> Column:
    """Similarity from packed signatures: equal lanes, corrected for those that agree by chance."""

    def differing(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        return F.bit_count(d.bitwiseAND(F.lit(0x1111111111111111)))

    equal = (F.lit(k) - F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda s, x: s + x)) / F.lit(float(k))
    chance = 2.0**-bits
    return (equal - chance) / (1 - chance)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int, most_broadcast: int = 500_000, span: int = 1000) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * shared >= percent * united. docs: doc_id, text.

    Pairs of one a are dealt to parts of about ``span``, each with a copy of its text.
    """
    wanted = materialize(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct())
    bounded = lambda rows: F.broadcast(rows) if rows.count() <= most_broadcast else rows  # noqa: E731  tens of bytes a row; beyond that a shuffled join
    texts = docs.join(bounded(wanted), "doc_id", "left_semi")
    often = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > span).select("a", F.ceil(F.col("n") / span).alias("parts"))
    often = bounded(materialize(often))  # fewer than one in ``span`` pairs
    dealt = pairs.select("a", "b").join(often, "a", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), F.col("parts")), F.lit(0)).alias("part"))
    side_a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")).join(often, "a", "left")
    side_a = side_a.select("a", "text_a", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    side_b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    joined = dealt.join(side_b, "b").join(side_a, ["a", "part"]).select("a", "b", "text_a", "text_b")

    def test(batches):
        last: tuple = (None, None)
        import pyarrow as pa

        for batch in batches:
            keep, ids, texts = [], batch.column(0).to_pylist(), batch.column(2)
            for k, words in tokenized(batch.column(3), LOWER):
                for i, other in enumerate(shingle_sets(words), k):
                    text = texts[i].as_py() or ""
                    if last[0] != (ids[i], text):
                        last = (ids[i], text), shingles(text)
                    keep.append(similar(last[1], other, percent))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(test, "a long, b long")


def floor_of(percent: int) -> float:
    """Over five standard deviations of the estimate below the threshold."""
    return percent / 100 - 0.22


def in_blocks(rows: DataFrame, held: DataFrame, docs: DataFrame, percent: int, block: int = 1000, most_shingles: int = 400_000) -> DataFrame:
    """Links (a, b) across components within large buckets. rows: doc_id, a (the bucket's smallest id), c (component).

    Buckets that share documents make one cluster. In each, the documents outside of the largest component
    are queries against all; both sides are cut into blocks, and a task compares one block with another. A block
    has about ``block`` documents or ``most_shingles`` shingles, whichever is less.
    """
    coarse = components(rows.select("a", F.col("doc_id").alias("b"))).withColumnRenamed("id", "doc_id")
    members = rows.select("doc_id", "c").distinct().join(coarse, "doc_id", "left").select("doc_id", "c", F.coalesce("component", "doc_id").alias("g"))
    members = materialize(members.join(held.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles")), "doc_id"))
    sums = members.groupBy("g", "c").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("w"))
    sums = sums.groupBy("g").agg(F.max_by("c", F.struct("n", "c")).alias("largest"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.max(F.struct("n", "c", "w")).alias("m"))
    parts = lambda n, w: F.greatest(F.ceil(n / block), F.ceil(w / most_shingles), F.lit(1))
    cuts = sums.select("g", "largest", parts(F.col("n"), F.col("w")).alias("tn"), parts(F.col("n") - F.col("m.n"), F.col("w") - F.col("m.w")).alias("qn"))
    full = members.drop("n_shingles").join(held.drop("n_shingles"), "doc_id").join(docs, "doc_id").join(cuts, "g")
    spot = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    columns = ["g", "doc_id", "c", "signature", "bands", "text"]
    asked = full.where("c <> largest").select(*columns, F.lit(True).alias("asks"), spot("qn").alias("q"), every("tn").alias("t"))
    present = full.select(*columns, F.lit(False).alias("asks"), every("qn").alias("q"), spot("tn").alias("t"))
    lanes, chance, floor = N_HASHES, 2.0**-LOW_BITS, floor_of(percent)

    def compare(frame):
        import pandas as pd

        ask, rest = frame[frame["asks"]], frame[~frame["asks"]].reset_index(drop=True)
        out: list[tuple[int, int]] = []
        if len(ask) and len(rest):
            sig, bands = np.stack(rest["signature"].to_numpy()).view(np.uint64), np.stack(rest["bands"].to_numpy())
            ids, groups, sets = rest["doc_id"].to_numpy(), rest["c"].to_numpy(), {}
            for x, c, s, b, text in zip(ask["doc_id"], ask["c"], ask["signature"], ask["bands"], ask["text"], strict=True):
                d = sig ^ np.asarray(s, np.int64).view(np.uint64)
                d |= d >> np.uint64(1)
                d |= d >> np.uint64(2)
                equal = 1 - np.bitwise_count(d & np.uint64(0x1111111111111111)).sum(axis=1) / lanes
                fit = ((equal - chance) / (1 - chance) >= floor) & (groups != c) & (bands == np.asarray(b)).any(axis=1)
                own, linked = shingles(text or ""), set()
                for k in np.flatnonzero(fit):
                    if groups[k] in linked:  # one link joins the components
                        continue
                    if k not in sets:
                        sets[k] = shingles(rest["text"][k] or "")
                    if similar(own, sets[k], percent):
                        linked.add(groups[k])
                        out.append((min(x, ids[k]), max(x, ids[k])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return asked.unionByName(present).groupBy("g", "q", "t").applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", most_broadcast: int = 500_000) -> DataFrame:
    """For each row of docs: doc_id, n_shingles, component_id (the smallest id reachable over links) and kept.

    Documents without words have 0 shingles and are linked with nothing, as are rows with a null id
    (component null, kept). Rows with equal ids count as one document: whatever any of their texts is linked
    with is linked, in any order of the rows. Other columns are left out; no rows give no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    made = materialize(features(docs))
    usable = made.where("d1 is not null and doc_id is not null")
    classes = usable.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    copied = materialize(classes.where("n > 1"))
    total = made.count()
    placed = spread_join(made, copied, ["d1", "d2"], "n", total, F.xxhash64("doc_id")).withColumn("rep", F.coalesce("rep", "doc_id"))
    # ids of several texts: their classes are linked
    several = usable.groupBy("doc_id").agg(F.min("d1").alias("x"), F.max("d1").alias("y")).where("x <> y")
    same_id = placed.where("rep <> doc_id").join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    reps = placed.where("doc_id = rep and bands is not null").dropDuplicates(["doc_id", "d1", "d2"])
    cells = reps.select("doc_id", F.explode("bands").alias("band"))
    shared = cells.groupBy("band").agg(F.min("doc_id").alias("a"), F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets = materialize(spread_join(cells, shared, ["band"], "size", N_BANDS * total, F.xxhash64("doc_id")).where("size is not null"))
    held = materialize(reps.join(buckets.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "n_shingles", "signature", "bands"))
    of = lambda x: held.select(F.col("doc_id").alias(x), F.col("signature").alias(f"s_{x}"))
    near = estimate(F.col("s_a"), F.col("s_b")) >= floor_of(percent)
    star = materialize(buckets.where("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct())
    centres = of("a").join(star.groupBy("a").agg(F.count(F.lit(1)).alias("n")), "a")
    tried = materialize(spread_join(star.join(of("b"), "b"), centres, ["a"], "n", star.count(), F.xxhash64("b")).where(near).select("a", "b").distinct())
    links = materialize(confirmed(tried, docs, percent).unionByName(same_id))
    first = components(links).withColumnRenamed("id", "doc_id")
    labelled = buckets.join(first, "doc_id", "left").select("band", "doc_id", "size", "a", F.coalesce("component", "doc_id").alias("c"))
    parts = labelled.groupBy("band", "c").agg(F.count(F.lit(1)).alias("n"))
    mixed = parts.groupBy("band").agg(F.count(F.lit(1)).alias("k"), F.max_by("c", F.struct("n", "c")).alias("largest"), F.sum("n").alias("n")).where("k > 1").drop("k")
    rest = spread_join(labelled.where("size > 2"), mixed, ["band"], "n", N_BANDS * total, F.xxhash64("doc_id")).where("largest is not null")
    rest = materialize(rest.drop("n"))
    small = rest.where(F.col("size") <= SMALL)
    one = small.where("c <> largest").select("band", F.col("doc_id").alias("x"), F.col("c").alias("cx"))
    other = small.select("band", F.col("doc_id").alias("y"), F.col("c").alias("cy"), "largest")
    across = one.join(other, "band").where(((F.col("cy") == F.col("largest")) | (F.col("x") < F.col("y"))) & (F.col("cx") != F.col("cy")))
    pairs = across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    more = pairs.join(of("b"), "b").join(of("a"), "a").where(near).select("a", "b").distinct().join(tried, ["a", "b"], "left_anti")
    found = links.unionByName(confirmed(materialize(more), docs, percent)).unionByName(in_blocks(rest.where(F.col("size") > SMALL), held, docs, percent))
    found = materialize(components(found))
    placed, found = placed.select("doc_id", "n_shingles", "rep"), found.withColumnRenamed("id", "rep")
    if found.count() <= most_broadcast:  # 16 bytes a row
        final = placed.join(F.broadcast(found), "rep", "left")
    else:
        final = spread_join(placed, found.join(placed.groupBy("rep").agg(F.count(F.lit(1)).alias("n")), "rep"), ["rep"], "n", total, F.xxhash64("doc_id"))
    return final.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_deduplicated(docs: DataFrame, percent: int = 75, most_broadcast: int = 2_000_000) -> DataFrame:
    """The rows of docs that stay: of each component the document with the smallest id; columns as in docs."""
    gone = materialize(near_duplicates(docs, percent).where("not kept").select("doc_id").distinct())
    small = gone.count() <= most_broadcast  # 8 bytes a row; beyond that a shuffled join
    return docs.join(F.broadcast(gone) if small else gone, "doc_id", "left_anti").select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i : i + 4], ' ') END AS sh
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON r.id = e.a AND r.c < e.b),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d JOIN m ON m.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
