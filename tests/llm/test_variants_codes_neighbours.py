"""Spelling variants, vector codes and nearest neighbours against brute force: nulls, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from streamlode.llm import nearest, spelling, vector_codes

DOCS = "doc_id long, text string"
VECTORS = "vec_id long, embedding array<float>, label int"


# --- spelling variants ------------------------------------------------------------------------------------


def one_edit(a, b):
    """Whether one inserted, deleted or replaced character makes a of b."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def counts_of(rows, every, shortest, fewest):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    return {w: c for w, c in n.items() if len(w) >= shortest and c >= fewest}


def grouped(words, ratio=5):
    """word: (n, n_near, form, form_n, root)"""
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (words[w], len(near[w]), form[w], words.get(form[w]), root(w)) for w in words}


def as_rows(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def invented(seed, count, letters="abÉ"):
    rng = random.Random(seed)
    words = {}
    while len(words) < count:
        base = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 9)))
        for _ in range(4):
            k = rng.randrange(len(base) + 1)
            words[rng.choice((base, base[:k] + rng.choice(letters) + base[k:], base[:k] + base[k + 1 :], base[:k] + rng.choice(letters) + base[k + 1 :]))] = rng.choice((1, 2, 5, 10, 26, 130))
    words.pop("", None)
    return words


@pytest.mark.parametrize("most", [1, 4, 1000])
def test_one_edit_pairs_for_any_bucket_size(spark, most):
    words = invented(1, 300)
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = [(r.a, r.b) for r in spelling.one_edit_pairs(df, most).collect()]
    want = {frozenset((a, b)) for a in words for b in words if one_edit(a, b)}
    assert len(got) == len(want) and {frozenset(p) for p in got} == want


def test_forms_and_roots(spark):
    words = {"colour": 700, "color": 125, "colr": 25, "colx": 25, "col": 5, "other": 3, "bother": 3, "mother": 15, "solo": 1} | invented(2, 60, "xyz")
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert as_rows(spelling.group_variants(df, 5, 2)) == grouped(words)
    assert as_rows(spelling.group_variants(df.where("n < 0"))) == {}


def test_words_are_counted_over_whole_texts(spark):
    rng = random.Random(4)
    vocabulary = [w for w in invented(5, 400, "abcdEÉ×÷ÿ") if len(w) > 4]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(120)) + "Ātail1Abcdef_Abcdef") for i in range(40)]
    rows += [(None, "Abcdef " * 7), (3, None), (3, ""), (5, "abcdef-ABCDEF\nabcdef"), (5, "abcdef-ABCDEF\nabcdef"), (-7, "日本 abcdef日abcdeg " * 50)]
    df = spark.createDataFrame(rows, DOCS).withColumns({"word": F.lit("x"), "n": F.lit(3), "key": F.lit("k")}).repartition(5)
    for every in (3, 199):
        want = counts_of(rows, every, 5, 2)
        assert {r.word: r.n for r in spelling.word_counts(df, every=every, shortest=5, fewest=2).collect()} == want
    assert as_rows(spelling.spelling_variants(df, every=3, shortest=5, fewest=2)) == grouped(want if every == 3 else counts_of(rows, 3, 5, 2))
    assert spelling.spelling_variants(df.limit(0)).count() == 0


def test_long_texts_and_full_tasks(spark, monkeypatch):
    text = "Abcdefg " * 3 + "x" * 2_000 + " éééééé" * 9
    for long in (1 << 20, 100):
        monkeypatch.setattr(spelling, "LONG", long)
        assert spelling.runs_of(text.encode()) == {"abcdefg": 3, "x" * 2_000: 1, "é" * 6: 9}
        assert spelling.runs_of(b"Ab ab") == {b"ab": 2}


# --- vector codes -----------------------------------------------------------------------------------------


def coded(rows, parts=4, entries=256, rounds=4, scale=1024):
    """Codes and errors by full scans with whole numbers of Python."""
    kept = sorted(((i, [math.floor(float(np.float32(v)) * scale) for v in x]) for i, x in rows), key=lambda r: ((r[0] is None), r[0] or 0, r[1]))
    width = len(kept[0][1])
    edges = [0, *np.cumsum([len(x) for x in np.array_split(np.arange(width), parts)]).tolist()]
    books = [[x[s:e] for _, x in kept[:entries]] for s, e in zip(edges[:-1], edges[1:], strict=True)]
    nearest_of = lambda book, v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(book))
    for turn in range(rounds + 1):
        at = [[nearest_of(books[p], x[edges[p] : edges[p + 1]]) for p in range(parts)] for _, x in kept]
        if turn == rounds:
            break
        for p in range(parts):
            for k in range(len(books[p])):
                own = [x[edges[p] : edges[p + 1]] for (_, x), a in zip(kept, at, strict=True) if a[p][1] == k]
                if own:
                    books[p][k] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    out = [(i, "".join(f"{k:02x}" for _, k in a), sum(d for d, _ in a)) for (i, _), a in zip(kept, at, strict=True)]
    return out, hashlib.sha256(",".join(str(v) for b in books for c in b for v in c).encode()).hexdigest()


def vectors(seed, count, width, kinds=4):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(kinds, width))
    rows = [(int(i) * 3, (centres[i % kinds] + draw.normal(size=width) / 9).astype(np.float32).tolist(), int(i % 3) if i % 5 else None) for i in draw.permutation(count)]
    return rows + [(rows[0][0], rows[0][1], 1), (rows[1][0], rows[2][1], 2), (None, rows[3][1], None), (None, rows[4][1], 7)]


BAD = [(1, None, 1), (2, [1.0, None], 1), (4, [float("nan")] * 8, 1), (5, [float("inf")] + [0.0] * 7, 1), (7, [1.0] * 5, 1), (8, [], 1), (10, [3e30] * 8, 1)]


@pytest.mark.parametrize("entries", [3, 16, 256])
def test_codes_equal_full_scans(spark, entries):
    rows = vectors(1, 90, 8)
    df = spark.createDataFrame(rows + BAD, VECTORS).withColumns({"code": F.lit("old"), "n": F.lit(1), "part": F.lit("p")}).repartition(4)
    found, books = vector_codes.compress(df, entries=entries)
    want, digest = coded([r[:2] for r in rows], entries=entries)
    got = [(r.vec_id, r.code, r.error) for r in found.collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and vector_codes.digest(books) == digest
    assert set(found.columns) == {"vec_id", "label", "code", "error", "n", "part"}
    sums = {}
    labelled = vector_codes.with_group_error(found.withColumn("label_error", F.lit("old"))).collect()
    for r in labelled:
        sums[r.label] = sums.get(r.label, 0) + r.error
    assert all(r.label_error == sums[r.label] for r in labelled) and len(labelled) == len(rows)


def test_odd_widths_and_large_numbers(spark):
    rows = [(i, [float(v) for v in x], 0) for i, x in enumerate(np.random.default_rng(2).integers(-200_000, 200_000, size=(40, 6)))]
    found, books = vector_codes.compress(spark.createDataFrame(rows, VECTORS), entries=5)
    want, digest = coded([r[:2] for r in rows], entries=5)
    assert sorted((r.vec_id, r.code, r.error) for r in found.collect()) == sorted(want) and vector_codes.digest(books) == digest
    with pytest.raises(ValueError):
        vector_codes.compress(spark.createDataFrame(rows, VECTORS), entries=257)


def test_no_vectors(spark):
    found, books = vector_codes.compress(spark.createDataFrame(BAD[:4], VECTORS))
    assert found.count() == 0 and vector_codes.digest(books) == hashlib.sha256(b"").hexdigest()
    assert vector_codes.with_group_error(found).count() == 0


def test_search_scans_a_part_of_the_entries_and_breaks_ties_by_index():
    draw = np.random.default_rng(3)
    entries = np.concatenate([draw.integers(-20, 20, size=(8, 3)) + 1000 * k for k in range(32)])
    entries[100] = entries[7]
    book = vector_codes.Codebook(entries)
    points = entries[draw.integers(0, 256, 4000)] + draw.integers(-6, 7, size=(4000, 3))
    full = vector_codes.distances(points, entries)
    before = np.where(draw.random(4000) < 0.8, full.argmin(1), draw.integers(0, 256, 4000))
    at, error = book.nearest(points, before)
    assert (at == full.argmin(1)).all() and (error == full.min(1)).all()
    assert book.scanned < 4000 * 256 / 3
    big = points.astype(np.int64) * 60_000
    assert (vector_codes.distances(big, big[:5]) == ((big[:, None] - big[None, :5]) ** 2).sum(2)).all()


# --- nearest neighbours -----------------------------------------------------------------------------------


def brute(rows, queries, wanted):
    """query: (vec_id, score) of the nearest, ties to the smaller id."""
    out = {}
    for q, x, *_ in queries:
        d = sorted({(math.sqrt(sum((float(a) - float(b)) ** 2 for a, b in zip(np.float32(x).tolist(), np.float32(y).tolist(), strict=True))), i) for i, y, *_ in rows if i != q})
        out[q] = [(i, s) for s, i in d[:wanted]]
    return out


def found_by(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=1e-12, atol=0)


def test_small_tables_are_searched_whole(spark):
    rows = [(i, x, y) for i, x, y in vectors(7, 80, 8) if i is not None and x[0] != 1]
    ids = {}
    rows = [r for r in rows if ids.setdefault(r[0], r[1]) == r[1]]  # one vector an id
    rows += [(1000 + i, rows[5][1], 0) for i in range(30)] + [(2000, [0.0] * 8, 0), (None, rows[1][1], 0)]
    df = spark.createDataFrame(rows + BAD, VECTORS).withColumns({"x": F.lit(1), "i": F.lit(2), "rank": F.lit(0)}).repartition(3)
    fine = [r for r in rows if r[0] is not None and any(r[1])] + [BAD[-1]]
    queries = df.where("vec_id % 9 = 0 or vec_id >= 1000")
    want = brute(fine, [r for r in fine if r[0] % 9 == 0 or r[0] >= 1000], 10)
    same(found_by(nearest.search(df.unionByName(df), queries)), want)


def test_few_or_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], 0), (5, [1.0, 2.0], 0), (7, [4.0, 6.0], 0)], VECTORS)
    assert found_by(nearest.search(df, df.where("vec_id = 0"))) == {0: [(5, 0.0), (7, 5.0)]}
    assert nearest.search(df, df.where("vec_id = 9")).count() == 0
    assert nearest.search(df.limit(0), df.limit(0)).columns == ["query_id", "rank", "vec_id", "score"]
    assert nearest.search(df.where("vec_id = 0"), df.where("vec_id = 0")).count() == 0


@pytest.mark.parametrize("kind", ["clustered", "unstructured"])
def test_recall(spark, kind, monkeypatch):
    draw = np.random.default_rng(9)
    x = draw.normal(size=(3000, 16))
    if kind == "clustered":
        x = x / 8 + draw.normal(size=(40, 16))[draw.integers(0, 40, 3000)]
    rows = [(i, v, 0) for i, v in enumerate(x.astype(np.float32).tolist())]
    df = spark.createDataFrame(rows, VECTORS).repartition(4)
    monkeypatch.setattr(nearest, "BLOCK", 20)  # several blocks of queries
    got = found_by(nearest.search(df, df.where("vec_id % 60 = 0"), first=40, sample=1200))
    x = np.array([r[1] for r in rows])
    hits = 0
    for q, found in got.items():
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len({i for i, _ in found} & set(np.argsort(d)[:10].tolist()))
        assert len(found) == 10 and all(abs(s - math.sqrt(d[i])) < 1e-9 for i, s in found)
    assert len(got) == 50 and hits / 500 >= 0.9


def test_heap_takes_cells_by_their_sum():
    draw = np.random.default_rng(4)
    grid = nearest.Grid(np.zeros((6, 2)), np.zeros((7, 2)))
    grid.counts = draw.integers(0, 5, size=(6, 7))
    a, b = draw.random(6), draw.random(7)
    cells = sorted((a[i] + b[j], grid.counts[i, j]) for i in range(6) for j in range(7))
    for rows in (1, 20, int(grid.counts.sum()), 10_000):
        held, want = 0, 0.0
        for want, n in cells:
            held += n
            if held >= rows:
                break
        assert grid.reach(a, b, rows) == pytest.approx(want)
