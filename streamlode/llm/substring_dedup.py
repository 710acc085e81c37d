"""Substring deduplication: words in windows that also start earlier in the corpus are removed.

Every window of 20 words has one minimizer, the least hash among its 8-word grams, and up to 20 consecutive
windows with the same one make a segment. Equal windows have equal minimizers, so a repeated window lies in
segments of one minimizer. One pass over the texts writes the places of all segments, without their words.

Equal segments (by 128 bits of two hashes) are collapsed to their first occurrence: all later ones repeat it.
Where distinct segments share a minimizer, or a segment may repeat itself, the words of the first occurrences are
fetched and go to the shard of that minimizer. A shard builds an FM-index over its segments and streams each of them
through backward search over the wavelet matrix. That gives matching statistics: for each word the length of the longest run up
to it, of at most 20 words, that stands elsewhere in the shard. Where it reaches the window, the suffix interval tells the
earliest occurrence, and the window is reported if that is another, earlier one.

A minimizer of more segments than a shard should hold is split by the next smaller hashes among the grams of each
window, level by level, until its parts fit: equal windows have equal parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_values, discard, gram_hashes, materialize, mix64, run_sums, spread_join, tokenized
from .fm_index import FMIndex

WINDOW, GRAM = 20, 8
PLAIN = byte_values()
#: Stands for a null id, which comes before all others.
FIRST = -(2**63)


def extreme(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """best (np.minimum or np.maximum) over each run of ``width`` values, by doubling."""
    done = 1
    while 2 * done <= width:
        x, done = best(x[:-done], x[done:]), 2 * done
    return x if done == width else best(x[: len(x) - (width - done)], x[width - done :])


def segments(words: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimizer, first window, number of windows (at most ``window``) of each segment of a document's word hashes,
    and whether the segment may hold one window twice."""
    if len(words) < window:
        empty = np.empty(0, np.int64)
        return np.empty(0, np.uint64), empty, empty, np.empty(0, bool)
    grams, width = gram_hashes(words, gram), window - gram + 1
    least = extreme(grams, width, np.minimum)
    first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    n = np.diff(np.append(first, len(least)))
    if n.max() > window:  # cut long runs
        pieces = -(-n // window)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = np.repeat(first, pieces) + nth * window
        n = np.minimum(np.repeat(n, pieces) - nth * window, window)
    # a gram is least in some window if the greatest minimum of the windows around it is its own hash
    side = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(grams == extreme(np.concatenate([side, least, side]), width, np.maximum))
    close = (np.diff(at) <= width) & (grams[at[1:]] == grams[at[:-1]])
    own = np.isin(least[first], grams[at[1:][close]]) if close.any() else np.zeros(len(first), bool)
    return least[first], first, n, own


def occurrences(docs: DataFrame) -> DataFrame:
    """doc_id (FIRST for null), row, start, n (windows), m, s (hash of the segment) and own, for all segments of docs (doc_id, row, text)."""
    schema = "doc_id long, row long, start long, n int, m long, s long, own boolean"

    def run(batches):
        import pyarrow as pa

        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            ids, rows = batch.column(0).fill_null(FIRST).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for k, words in tokenized(batch.column(2), PLAIN):
                found = [segments(words.of(j)) for j in range(len(words))]
                sizes = [len(m) for m, _, _, _ in found]
                if not sum(sizes):
                    continue
                m, first, n, own = map(np.concatenate, zip(*found, strict=True))
                start = first + np.repeat(words.first[:-1], sizes)
                s = mix64(run_sums(words.hashes, start, start + n + WINDOW - 1) + n.astype(np.uint64))
                columns = (np.repeat(ids[k : k + len(words)], sizes), np.repeat(rows[k : k + len(words)], sizes), first, n.astype(np.int32), m.view(np.int64), s.view(np.int64), own)
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names)

    return docs.mapInArrow(run, schema)


def with_words(firsts: DataFrame, docs: DataFrame, most_broadcast: int) -> DataFrame:
    """firsts (doc_id, row, start, n, m, s) with their words, read from docs (doc_id, row, text)."""
    # a document's segments are bounded by its length
    wanted = materialize(firsts.groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "n", "m", "s")).alias("found")))
    count, size = wanted.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("found")), F.lit(0))).first()
    small = count <= most_broadcast and size <= 5 * most_broadcast  # 32 bytes a segment; beyond that a shuffled join
    texts = docs.select(F.coalesce("doc_id", F.lit(FIRST)).alias("doc_id"), "row", "text")
    joined = texts.join(F.broadcast(wanted) if small else wanted, ["doc_id", "row"])

    def run(batches):
        import pandas as pd

        frame = lambda rows: pd.DataFrame(rows, columns=["doc_id", "start", "n", "m", "s", "words"])
        for b in batches:
            out = []
            for i, text, found in zip(b["doc_id"], b["text"], b["found"], strict=True):
                words = text.encode().split()
                out += [(i, x["start"], x["n"], x["m"], x["s"], b" ".join(words[x["start"] : x["start"] + x["n"] + WINDOW - 1])) for x in found]
                if len(out) > 20_000:
                    yield frame(out)
                    out = []
            if out:
                yield frame(out)

    found = joined.select("doc_id", "text", "found").mapInPandas(run, "doc_id long, start long, n int, m long, s long, words binary")
    return found.dropDuplicates(["m", "s"])  # repeated rows


def pieces(rows: DataFrame, level: int) -> DataFrame:
    """Segments (see ``split_hot``) cut into runs of windows whose ``level`` + 1 least gram hashes agree; at the last level the windows agree."""
    last = level == WINDOW - GRAM + 1

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            found = []
            for k, words in tokenized(batch.column(batch.schema.get_field_index("words")).cast(pa.string()), PLAIN):
                for j in range(len(words)):
                    hashes = words.of(j)
                    count = len(hashes) - WINDOW + 1
                    key = whole = mix64(run_sums(hashes, np.arange(count), np.arange(count) + WINDOW))
                    if not last:
                        grams = np.sort(np.lib.stride_tricks.sliding_window_view(gram_hashes(hashes, GRAM), WINDOW - GRAM + 1), axis=1)
                        key = np.zeros(count, np.uint64)
                        for column in grams[:, : level + 1].T:
                            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + column)
                    begins = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                    ends = np.append(begins[1:], count)
                    at = words.first[j]
                    for x, y, part, same in zip(begins.tolist(), ends.tolist(), key[begins].view(np.int64).tolist(), run_sums(whole, begins, ends).view(np.int64).tolist(), strict=True):
                        found.append((k + j, x, y - x, part, same, words.bytes_of(at + x, at + y + WINDOW - 1)))
            take, skip, n, part, same, text = zip(*found, strict=True) if found else [()] * 6
            out = batch.take(pa.array(take, pa.int64())).to_pydict()
            out["start"] = [x + a for x, a in zip(out["start"], skip, strict=True)]
            out["skip"] = [x + a for x, a in zip(out["skip"], skip, strict=True)]
            out |= {"n": n, "part": part, "same": same, "words": text}
            yield pa.RecordBatch.from_pydict(out, schema=batch.schema)

    return rows.mapInArrow(cut, rows.schema)


def split_hot(several: DataFrame, most_segments: int) -> tuple[DataFrame, DataFrame | None]:
    """several (doc_id, start, n, m, s, words) dealt to parts, and marks (m, s, mask) of windows that are known to be repeats.

    A part is a minimizer, or for one of over ``most_segments`` segments the windows that agree in their next least gram hashes too.
    Pieces of segments start at a later window (``skip`` counts those before). Of equal pieces the first stays, the others are marked.
    """
    rows = materialize(several.select("*", F.col("m").alias("part"), F.lit(0).alias("skip"), F.lit(0).cast("long").alias("same")))
    done, marks = [], None
    for level in range(1, WINDOW - GRAM + 2):
        hot = materialize(rows.groupBy("part").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > most_segments).select("part"))
        if hot.isEmpty():
            break
        # fewer hot parts than one in ``most_segments`` rows
        done.append(rows.join(F.broadcast(hot), "part", "left_anti").select(rows.columns))
        cut = materialize(pieces(rows.join(F.broadcast(hot), "part", "left_semi").select(rows.columns), level))
        first = cut.groupBy("part", "same").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count(F.lit(1)).alias("times"))
        placed = spread_join(cut, first, ["part", "same"], "times", cut.count(), F.xxhash64("doc_id", "start"))
        leads = F.struct("doc_id", "start") == F.col("first")
        whole = F.call_function("shiftleft", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("n")) - 1, F.col("skip"))
        later = materialize(placed.where(~leads).select("m", "s", whole.alias("mask")))
        marks = later if marks is None else marks.unionByName(later)
        rows = materialize(placed.where(leads).select(rows.columns))
        discard(cut)
    for cool in done:
        rows = rows.unionByName(cool)
    return rows, marks


def earlier_windows(frame, window: int = WINDOW):
    """m, s, mask for the segments of a shard (see ``split_hot``): the windows that start earlier elsewhere."""
    import pandas as pd

    frame = frame.drop_duplicates(["m", "s", "skip"]).sort_values(["doc_id", "start"]).reset_index(drop=True)
    codes: dict[bytes, int] = {}
    parts = [w.split() for w in frame["words"]]
    lengths = np.array([len(p) for p in parts])
    flat = np.fromiter((codes.setdefault(w, len(codes) + 1) for p in parts for w in p), np.int64, lengths.sum())
    begin = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]  # of each segment, with a separator after each
    text = np.zeros(int((lengths + 1).sum()), np.int64)
    owner = np.repeat(np.arange(len(parts)), lengths)
    offset = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    text[begin[owner] + offset] = flat
    n = frame["n"].to_numpy()
    of = np.repeat(np.arange(len(parts)), n)
    inside = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    index = FMIndex(text, window)
    # when each text position comes in the corpus: by document, then by place in it
    place, whose = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
    place[begin[owner] + offset] = frame["start"].to_numpy()[owner] + offset
    whose[begin[owner] + offset] = np.unique(frame["doc_id"].to_numpy(np.int64), return_inverse=True)[1][owner]
    when = np.unique(whose << 40 | place, return_inverse=True)[1].reshape(-1)
    by_suffix = np.append(when[index.order], np.iinfo(np.int64).max)
    at = begin[of] + inside
    early = np.zeros(len(at), bool)
    for a in range(0, len(at), 50_000):
        some = at[a : a + 50_000]
        length, low, high = index.matching_statistics(text, some + window - 1, window)
        long = np.flatnonzero(length == window)
        if len(long):
            cut, back = np.unique(low[long] << 32 | high[long], return_inverse=True)
            ends = np.stack([cut >> 32, cut & 0xFFFFFFFF], axis=1).reshape(-1)
            least = np.minimum.reduceat(by_suffix, ends)[::2]
            early[a + long] = least[back.reshape(-1)] < when[some[long]]
    mask = np.zeros(len(parts), np.int64)
    np.bitwise_or.at(mask, of[early], np.int64(1) << inside[early])
    out = pd.DataFrame({"m": frame["m"], "s": frame["s"], "mask": mask << frame["skip"].to_numpy(np.int64)})
    return out[out["mask"] != 0]


def remove_repeats(docs: DataFrame, shard_words: int = 300_000, most_segments: int = 5_000, most_broadcast: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (kept words joined by one space), n_words and n_removed for each row of docs; other columns are left out.

    Null texts have no words. A null id comes before all ids. Rows that share an id are judged by their
    place in the text alone: at one id and start neither is earlier. No rows give no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("row", F.xxhash64("text"))
    found = materialize(occurrences(docs.select("doc_id", "row", "text")))
    twice = found.groupBy("m").agg(F.count(F.lit(1)).alias("k"), F.min("s").alias("x"), F.max("s").alias("y"), F.max("own").alias("z"))
    twice = materialize(twice.where("k > 1 or z").select("m", "k", F.expr("x <> y or z").alias("several")))
    near = spread_join(found.drop("own"), twice, ["m"], "k", found.count(), F.col("s")).where("k is not null").drop("k")
    near = materialize(near)
    discard(found, twice)
    distinct = near.groupBy("m", "s").agg(F.min(F.struct("doc_id", "start", "n", "row")).alias("first"), F.count(F.lit(1)).alias("times"), F.max("several").alias("several"))
    distinct = materialize(distinct.where("times > 1 or several").select("m", "s", "first.*", "times", "several"))
    rows, marks = split_hot(with_words(distinct.where("several").drop("times", "several"), docs, most_broadcast), most_segments)
    total = rows.agg(F.sum(F.col("n") + WINDOW)).first()[0] or 0
    shards = max(1, -(-total // shard_words))
    masks = rows.withColumn("shard", F.pmod(F.xxhash64("part"), F.lit(shards))).groupBy("shard").applyInPandas(lambda f: earlier_windows(f), "m long, s long, mask long")
    masks = materialize(masks if marks is None else masks.unionByName(marks))
    # a row for each segment: its first place and count, and the masks of its pieces
    both = distinct.select("m", "s", F.col("doc_id").alias("d0"), F.col("start").alias("p0"), "times", F.lit(0).cast("long").alias("mask"))
    none = F.lit(None).cast("long")
    both = both.unionByName(masks.select("m", "s", none.alias("d0"), none.alias("p0"), none.alias("times"), "mask"))
    known = both.groupBy("m", "s").agg(*(F.max(c).alias(c) for c in ("d0", "p0", "times")), F.bit_or("mask").alias("mask")).where("times > 1 or mask <> 0")
    placed = spread_join(near.select("doc_id", "row", "start", "n", "m", "s"), known, ["m", "s"], "times", near.count(), F.xxhash64("doc_id", "start")).where("times is not null")
    first = (F.col("doc_id") == F.col("d0")) & (F.col("start") == F.col("p0"))
    whole = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("n")) - 1
    marked = placed.select("doc_id", "row", "start", F.when(first, F.col("mask")).otherwise(whole).alias("mask")).where("mask <> 0")
    # a document's spans are bounded by its length
    spans = materialize(marked.groupBy("doc_id", "row").agg(F.collect_list("start").alias("starts"), F.collect_list("mask").alias("masks")))
    discard(near, distinct)
    # spans grow with the corpus: always a shuffled join
    spans = spans.withColumnRenamed("doc_id", "d").withColumnRenamed("row", "r").hint("merge")
    joined = docs.join(spans, (F.coalesce("doc_id", F.lit(FIRST)) == F.col("d")) & (F.col("row") == F.col("r")), "left")

    def run(batches):
        import pandas as pd

        for b in batches:
            out = []
            for text, starts, masks in zip(b["text"], b["starts"], b["masks"], strict=True):
                words = text.encode().split()
                if starts is None:
                    out.append((b" ".join(words), len(words), 0))
                    continue
                bits = np.asarray(masks, np.int64)[:, None] >> np.arange(WINDOW) & 1
                ones = (np.asarray(starts, np.int64)[:, None] + np.arange(WINDOW))[bits == 1]
                gone = np.bincount(ones, minlength=len(words) + WINDOW + 1)
                gone = np.cumsum(gone - np.concatenate([np.zeros(WINDOW, np.int64), gone[:-WINDOW]]))[: len(words)] > 0
                out.append((b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]), len(words), int(gone.sum())))
            frame = pd.DataFrame(out, columns=["text", "n_words", "n_removed"])
            frame["text"] = frame["text"].map(bytes.decode)
            frame.insert(0, "doc_id", b["doc_id"].to_numpy())
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return joined.select("doc_id", "text", "starts", "masks").mapInPandas(run, "doc_id long, text string, n_words long, n_removed long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
v AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 19], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM v) WHERE k > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM r),
x AS (SELECT w.doc_id, list(p) AS ps FROM w JOIN g USING (doc_id) GROUP BY w.doc_id),
k AS (SELECT w.doc_id, len(ws) AS n, ws, coalesce(ps, []) AS ps FROM w LEFT JOIN x USING (doc_id)),
o AS (SELECT doc_id, n, ps, CASE WHEN len(ps) = 0 THEN ws ELSE list_transform(list_filter(range(1, n + 1), lambda p: NOT list_contains(ps, p)), lambda p: ws[p]) END AS kept FROM k)
SELECT doc_id, n AS n_words, len(ps) AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM o
"""
