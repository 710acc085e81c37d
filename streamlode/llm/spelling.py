"""Spelling variants: words that differ by one edit, found by an even-partition pigeonhole join.

A word is cut into two even segments. One edit leaves one of them whole, so an equally long word holds that segment at
the same place, and a word that is longer by one holds it at the same place (the first) or one further (the second).
Segments are indexed with the word's length; each word probes its substrings as an equally long and as a word longer by
one. What is left beside the segment, the tail, must be one edit away, which the join itself verifies.

A segment that over ``most`` words share is cut again: the tails in its bucket are partitioned by the same rule, so that
the key grows until few words share it or one character is left. No bucket emits all its pairs, and none is capped.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize

#: Maximal runs of letters, A-Z lower-cased already.
RUN = re.compile("[a-zÀ-ÿ]+")
ASCII_RUN = re.compile(rb"[a-z]+")
#: Distinct words that a task holds before it hands its counts on.
HELD = 200_000
#: Characters from which a text is gone through run by run.
LONG = 1 << 20


def runs_of(data: bytes) -> Counter:
    """How often each lower-cased run occurs in a text; ASCII texts give bytes, others strings."""
    data = data.lower()  # of bytes: A-Z alone
    if data.isascii():
        return Counter(ASCII_RUN.findall(data) if len(data) < LONG else (m.group() for m in ASCII_RUN.finditer(data)))
    text = data.decode("utf-8", "replace")
    return Counter(RUN.findall(text) if len(text) < LONG else (m.group() for m in RUN.finditer(text)))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 199, shortest: int = 6, fewest: int = 5) -> DataFrame:
    """word and n of the words of at least ``shortest`` characters that occur at least ``fewest`` times.

    Where ``every`` divides the crc32 h of "<id>:<run>", the run loses its character h % length. A null id counts as
    empty, a null text has no words. Counts are summed within tasks first, so a frequent word moves once a task.
    """

    def count(batches) -> Iterator:
        import pyarrow as pa

        held: Counter = Counter()

        def table():
            words = pa.array(list(held), pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for doc, data in zip(b.column(0).to_pylist(), b.column(1)):
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for run, n in runs_of(data.as_py() or b"").items():
                    raw = run if type(run) is bytes else run.encode()
                    h = zlib.crc32(raw, start)
                    if h % every == 0:
                        run = run[: h % len(run)] + run[h % len(run) + 1 :]
                        raw = run if type(run) is bytes else run.encode()
                    if len(run) >= shortest:
                        held[raw] += n
                if len(held) >= HELD:
                    yield table()
                    held.clear()
        yield table()

    texts = docs.select(F.col(id_col).cast("string"), F.col(text_col).cast("string").cast("binary"))
    partial = texts.mapInArrow(count, "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= fewest)


def from_to(text: str, start: Column, end: Column) -> Column:
    """The characters of a column from start up to end, counted from 0."""
    return F.substring(F.col(text), (start + 1).cast("int"), (end - start).cast("int"))


def cut(rows: DataFrame) -> DataFrame:
    """rows: word, n, key, tail and longer (0 or 1: by how much the tail exceeds those of the index). Two rows for each, one a segment.

    The segments are those of an indexed tail of size - longer characters; the second starts one further in a longer tail.
    """
    size = F.length("tail")
    half = F.floor((size - F.col("longer")) / 2)
    part = lambda number, a, b, c, d: F.struct(F.concat_ws("|", "key", F.lit(number), from_to("tail", a, b)).alias("key"), from_to("tail", c, d).alias("tail"))
    zero, second = F.lit(0), half + F.col("longer")
    each = F.explode(F.array(part("1", zero, half, half, size), part("2", second, size, zero, second)))
    return rows.select("word", "n", "longer", each.alias("p")).select("word", "n", "longer", "p.key", "p.tail")


def one_edit_pairs(words: DataFrame, most: int = 32) -> DataFrame:
    """a, a_n, b, b_n: each pair of distinct words (word, n) that differ by one inserted, deleted or replaced character, once.

    ``most``: words that share a segment from which on the rest of them is cut again; it does not change the result.
    """
    whole = lambda longer: words.select("word", "n", (F.length("word") - longer).cast("string").alias("key"), F.col("word").alias("tail"), F.lit(longer).alias("longer"))
    rows, found = materialize(cut(whole(0).unionByName(whole(1)))), []
    while True:
        index = rows.where("longer = 0")
        # a tail of one character cannot be cut: the alphabet bounds its bucket
        hot = materialize(index.where(F.length("tail") > 1).groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > most).select("key"))
        many = hot.count() > 0
        usual = rows.join(hot, "key", "left_anti") if many else rows
        left = usual.where("longer = 0").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("tail").alias("a_tail"))
        right = usual.select(F.col("key").alias("b_key"), F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("tail").alias("b_tail"), "longer")
        near = ((F.col("longer") == 1) | (F.col("a") < F.col("b"))) & (F.levenshtein("a_tail", "b_tail", 1) == 1)
        pairs = right.join(left, (F.col("key") == F.col("b_key")) & near).select("a", "a_n", "b", "b_n")
        found.append(materialize(pairs))
        done, rows = rows, materialize(cut(rows.join(hot, "key", "left_semi"))) if many else None
        discard(done, hot)
        if rows is None:
            break
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    # a character inserted beside its equal leaves both segments whole: such pairs are found twice
    return every.dropDuplicates(["a", "b"])


def group_variants(words: DataFrame, ratio: int = 5, most: int = 32) -> DataFrame:
    """word, n, n_near, form, form_n, root for each row of words (word, n; words are distinct and not null).

    form is the near word of largest n, ties to the smallest in code point order, if its n is at least ``ratio`` (over 1)
    times the word's. root follows forms to the last. Roots are handed on from form to words, a level at a
    time; a word has at most as many words below it as one edit can make, so no key of these joins is hot.
    """
    pairs = one_edit_pairs(words, most)
    side = lambda a, b: F.struct(F.col(a).alias("word"), F.col(b).alias("other"), F.col(f"{b}_n").alias("other_n"))
    both = pairs.select(F.explode(F.array(side("a", "b"), side("b", "a"))).alias("p")).select("p.*")
    best = F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("w")))
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    joined = words.select("word", "n").join(near, "word", "left")
    takes = F.coalesce(-F.col("best.m") >= F.col("n") * ratio, F.lit(False))
    found = materialize(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("best.w")).alias("form"), F.when(takes, -F.col("best.m")).alias("form_n")))
    level, out = found.where("form is null").withColumn("root", F.col("word")), None
    below = found.where("form is not null")
    while True:
        out = level if out is None else out.unionByName(level)
        level = materialize(below.join(level.select(F.col("word").alias("form"), "root"), "form").select("word", "n", "n_near", "form", "form_n", "root"))
        if not level.count():
            discard(level)
            return out


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 199, shortest: int = 6, fewest: int = 5, ratio: int = 5, most: int = 32) -> DataFrame:
    """The words of docs with their forms and roots: see ``word_counts`` and ``group_variants``.

    Rows that share an id are documents of their own, repeated rows count as often as they occur; other columns are not
    read. Empty tables, and tables without words of that length, give no rows.
    """
    return group_variants(materialize(word_counts(docs, id_col, text_col, every, shortest, fewest)), ratio, most)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


#: crc32 by bytes: a table of 256 entries is made by the rule of the polynomial.
CRC_SQL = """bits AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
crc AS (SELECT s, xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(s))), lambda k: ('0x' || substr(hex(encode(s)), 2 * k + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM keys, bits)"""

SQL = rf"""
WITH RECURSIVE runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS doc, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
occ AS (SELECT run, doc || ':' || run AS s, count(*) AS n FROM runs GROUP BY ALL),
keys AS (SELECT DISTINCT s FROM occ), {CRC_SQL},
words AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, sum(n)::BIGINT AS n FROM occ JOIN crc USING (s) GROUP BY 1 HAVING length(word) >= 6 AND sum(occ.n) >= 5),
holes AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
shorter AS (SELECT DISTINCT h.word AS long, h.n AS long_n, w.word AS short, w.n AS short_n FROM holes h JOIN words w ON w.word = h.a || h.b),
near AS (SELECT x.word, y.word AS other, y.n AS other_n FROM holes x JOIN holes y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION ALL SELECT long, short, short_n FROM shorter UNION ALL SELECT short, long, long_n FROM shorter),
best AS (SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS k FROM near),
formed AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * w.n THEN other END AS form, CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word AND b.k = 1),
chain AS (SELECT word, word AS at, form AS next FROM formed UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON f.word = c.next)
SELECT f.word, form, c.at AS root, n, n_near, form_n FROM formed f JOIN chain c ON c.word = f.word AND c.next IS NULL
"""
