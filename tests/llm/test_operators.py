"""Small fixtures against brute force: nulls, empty tables, ties, repeated rows, clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from streamlode.llm import exact_dedup, fingerprint, minhash, mixing, packing, quality, substring_dedup, toxicity, url_filter, warc
from streamlode.llm.common import byte_values, find_words, tokenized
from streamlode.llm.components import components
from streamlode.llm.fm_index import FMIndex

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))


def hashes(words):
    """Hashes of words given as bytes, as the operators make them."""
    data = np.frombuffer(b" ".join(words), np.uint8)
    return find_words(data, np.array([0, len(data)]), byte_values()).hashes


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    base = [" ".join(f"t{rng.randrange(400)}" for _ in range(60)) for _ in range(6)]
    rows = []
    for i in range(n):
        words = rng.choice(base).split()
        for _ in range(rng.choice((0, 0, 1, 2, 6))):
            words[rng.randrange(60)] = f"x{rng.randrange(9)}"
        rows.append((i * 3, " ".join(words[: rng.choice((60, 60, 45))]), "en", rng.choice(("a", "b", None)), 1))
    rows += [(1000, None, None, None, None), (1001, "", "en", "b", 0), (1002, " \n", "en", "c", 2), (1003, "one two", "en", "a", 7), (1004, "One\ttwo", "en", "a", 7), (1005, LONG, "en", "d", 9), (1006, LONG + " ", "en", "d", 9)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, empty):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t, *_ in corpus():
        groups.setdefault(norm(t), []).append(i)
    clash = docs.withColumn("kept", F.lit("old")).withColumn("keep_id", F.lit(5))
    for blocks in (1 << 21, 1):
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(clash, max_blocks=blocks).collect()}
        assert got == {i: (min(g), len(g), i == min(g), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t, *_ in corpus() for g in [groups[norm(t)]]}
    twice = docs.unionByName(docs)
    assert sorted(r.doc_id for r in exact_dedup.deduplicated(twice).collect()) == sorted(min(g) for g in groups.values())
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_mixing(docs, empty):
    rows = mixing.mix(docs.withColumn("size", F.lit("old"))).collect()
    size = {i: len(WORD.findall(t or "")) for i, t, *_ in corpus()}
    assert {r.doc_id: r["size"] for r in rows} == size
    by = {}
    for r in rows:
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 3
        by.setdefault(r.source, [r.target, 0, r.source_size])[1] += r.taken
    assert sum(t for t, _, _ in by.values()) == pytest.approx(sum(size.values()))
    assert all(t <= 3 * s for t, _, s in by.values())
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.withColumn("size", F.lit("old"))).collect()))
    assert mixing.mixed(docs).count() == sum(r.copies for r in rows)
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).columns == docs.columns


def test_warc_round_trip(spark, tmp_path):
    html = "<p>" + "é" * 80
    pages = [(1, "http://a/", html), (2, None, html), (3, "http://b/ x\r\nEvil: 1", "short"), (4, "u", "short"), (5, "u", None), (6, "u", LONG), (6, "u", LONG), (None, "u", html)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2).withColumn("frame", F.lit(1))
    warc.write_archives(df, str(tmp_path / "w"))
    got = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert len(got) == len(pages)
    assert sorted((str(r.page_id), r.record_type, r.refers_to, r.payload_bytes) for r in got) == sorted(
        (str(i), "revisit" if h == html and i != 1 else "response", 1 if h == html and i != 1 else None, len((h or "").encode())) for i, _, h in pages
    )
    assert {bytes(r.payload) for r in got if r.payload is not None} == {(h or "").encode() for *_, h in pages}
    warc.write_archives(df.limit(0), str(tmp_path / "none"))
    data = bytes(next(p for p in (tmp_path / "w").glob("part-*") if p.stat().st_size > 100).read_bytes())
    assert list(warc.records_of(data))
    for broken in (data[:-20], data[:-14] + bytes([data[-14] ^ 255]) + data[-13:], data[8:]):
        with pytest.raises(Exception):  # noqa: B017
            list(map(warc.parse, warc.records_of(broken)))
    bad = warc.record(1, "u", hashlib.sha256(b"x").hexdigest(), b"y", None)
    with pytest.raises(ValueError):
        warc.parse(bad)


def brute_links(rows):
    sets = {}
    for i, t, *_ in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(t or "")]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    best = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            best[a] = best[b] = min(best[a], best[b])
    return sets, best


@pytest.mark.parametrize("small", [64, 3])
def test_near_duplicates(docs, empty, small, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", small)
    sets, best = brute_links(corpus())
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert got == {i: (len(s), best[i], best[i] == i) for i, s in sets.items()}
    if small == 64:
        assert minhash.near_duplicates(empty).count() == 0
        assert sorted(r.doc_id for r in minhash.near_deduplicated(docs).collect()) == sorted(i for i in best if best[i] == i)


def test_signatures_estimate_similarity(spark):
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64))
    b = np.unique(np.concatenate([a[:2400], rng.integers(0, 2**63, 600).astype(np.uint64)]))
    mins = minhash.minima([a, b])
    x, y = minhash.packed(mins).tolist()
    df = spark.createDataFrame([(x, y, x)], "x array<long>, y array<long>, z array<long>")
    near, same = df.select(minhash.estimate(F.col("x"), F.col("y")), minhash.estimate(F.col("x"), F.col("z"))).first()
    assert abs(near - 2400 / 3600) < 0.2 and same == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r["id"]: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}


def test_segments_tell_of_windows_that_they_hold_twice():
    for base in ([b"a"] * 70, [b"a", b"b", b"c"] * 20, [b"%d" % i for i in range(60)], [b"%d" % (i % 33) for i in range(90)]):
        m, first, n, own = substring_dedup.segments(hashes(base))
        windows = [tuple(base[i : i + 20]) for i in range(len(base) - 19)]
        assert n.sum() == len(windows) and n.max() <= 20
        for a, k, flag in zip(first, n, own, strict=True):
            assert flag or len(set(windows[a : a + k])) == k


def test_substring_dedup_within_runs_of_one_word(spark):
    rows = [(0, "a " * 60), (1, "b c " * 30), (2, " ".join(map(str, range(50))) + " a" * 25), (3, "x " + "a " * 200 + "y"), (4, "a " * 19)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for more in ({}, {"most_segments": 1}, {"most_broadcast": 0}):
        got = substring_dedup.remove_repeats(docs, **more).collect()
        assert {r.doc_id: (r.n_words, r.n_removed, r.text) for r in got} == brute_substrings(rows)


def brute_substrings(rows, n=20):
    words = [(i, WORD.findall(t or "")) for i, t, *_ in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            first[key] = min(first.get(key, (i, k)), (i, k))
    out = {}
    for i, w in words:
        gone = {p for k in range(len(w) - n + 1) if first[tuple(w[k : k + n])] < (i, k) for p in range(k, k + n)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out[i] = (len(w), len(gone), kept)
    return out


@pytest.mark.parametrize("most", [5000, 1])
def test_substring_dedup(docs, empty, most):
    rows = substring_dedup.remove_repeats(docs, shard_words=500, most_segments=most).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.text) for r in rows} == brute_substrings(corpus())
    if most == 1:
        assert substring_dedup.remove_repeats(empty).count() == 0


def test_fm_index():
    rng = np.random.default_rng(2)
    text = np.append(rng.integers(1, 4, 300), 0)
    index = FMIndex(text, 5)
    patterns = np.array([text[k : k + 5] for k in range(295)])
    low, high = index.search(patterns)
    for p, a, b in zip(patterns, low, high, strict=True):
        assert sorted(index.order[a:b]) == [k for k in range(296) if (text[k : k + 5] == p).all()]


def test_fingerprints(docs, empty):
    rows = sorted(corpus())
    for block in (1000, 5):
        got = {r.doc_id: r for r in fingerprint.fingerprints(docs, rows_a_block=block).collect()}
        assert len(got) == len(rows)
        for (i, t, *_), (_, u, *_) in zip(rows, rows[1:] + rows[:1], strict=True):
            t, u = t or "", u or ""
            new = t[: len(t) - len(t) // 4] + u[: len(t) // 4]
            assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
            assert got[i].near_next == fingerprint.containment(fingerprint.fingerprint(t), fingerprint.fingerprint(u))
    assert fingerprint.fingerprints(empty).count() == 0
    shifted = "inserted " + LONG
    assert fingerprint.containment(fingerprint.fingerprint(LONG), fingerprint.fingerprint(shifted)) > 0.95


def test_url_rules_and_ranks(spark):
    pages = [
        (1, "http://A.Example.com/en/7x?q", ""), (2, "http://example.com/en/1", ""), (3, "http://notexample.com/fr/1", ""), (4, "https://x.example.net/de/8", ""),
        (5, "//none", None), (6, None, None), (7, "http://bad.com/en/", '<a href="http://good.net/">'), (8, "http://bad.com/zz", ""), (9, "http://good.net/de/1", ""), (10, "http://good.net/x#y", ""),
        (11, "http://links.org/a", '<a href="http://bad.com/">'),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("old"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df).collect()}
    assert got[1] == ("a.example.com", "/en/7x", "example.com/en/7", "allow") and got[2][2:] == ("com/en/", "block")
    assert got[3][2] is None and got[4][2:] == ("example.net/de/8", "block")
    assert got[5] == got[6] == ("", "", None, "allow")
    assert got[8][3] == "block" and got[10][3] == "allow" and got[11][3] == "block"
    assert url_filter.judge(df.limit(0)).count() == 0


def test_packing(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    texts = {i: t or "" for i, t, *_ in corpus()}
    rows = packing.pack(docs, path, shard=20).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, t in texts.items():
        ids, at = np.array([*whole.encode(t, add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and at & (at - 1) == 0
    assert packing.pack(empty, path).count() == 0


@pytest.mark.parametrize("text", ["", " ", "a  b", " a", "a ", "a \n b", "don't  stop", "<|endoftext|> x<|endoftext|>", "\n\n a\t b ", "a\x85 b", "a \x1c b", "\0a \0b  \0", "a \0b", "a \1b\nc", "a.\nB\n\nc", "a\nb\r\nc \nd", "a\n", "1 2　3 4"])
def test_pieces_have_the_ids_of_the_whole(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, whole = packing.Encoder(path), Tokenizer.from_file(path)
    for texts in ([text], [text, "", "plain words here"], ["plain words", text]):
        assert [x.tolist() for x in encoder.encode(pa.array(texts, pa.string()))] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def labelled(spark, words, n=600):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        y = i % 4 == 0
        text = [f"t{rng.randrange(300)}" for _ in range(60)]
        if y:
            for _ in range(4):
                text[rng.randrange(60)] = rng.choice(words)
        rows.append((i, " ".join(text), "en", "a", 0))
        labels.append((i, int(not y), int(y)))
    return spark.createDataFrame(rows + [(9000, None, None, None, None), (9001, "", None, None, None)], SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark, empty):
    docs, labels = labelled(spark, ["scum", "trash", "idiot"])
    got = toxicity.scored(docs, labels).join(labels, "doc_id", "left").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.toxic is not None]
    assert sum(r.predicted == r.toxic for r in held) / len(held) > 0.95
    assert toxicity.scored(empty, labels).count() == 0
    assert {r.score for r in toxicity.scored(docs.limit(5), labels.limit(0)).collect()} == {0.5}


def test_quality(spark, empty):
    docs, labels = labelled(spark, ["!!!!!", "|", "|"])
    got = quality.scored(docs, labels).join(labels, "doc_id", "left").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.quality is not None]
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.95
    assert quality.scored(empty, labels).count() == 0 and quality.accepted(docs, labels).columns == docs.columns
    assert {r.score for r in quality.scored(docs.limit(5), labels.limit(0)).collect()} == {0.5}


def test_packing_finds_neighbours_anywhere_in_the_input(spark):
    import public_tokenizers

    rng = random.Random(5)
    topics = [[f"k{g}x{j}" for j in range(30)] for g in range(16)]
    rows = [(i, " ".join(rng.choices(topics[i % 16], k=200))) for i in range(160)]  # a topic's documents lie 16 rows apart
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4, "doc_id")
    by_seq = {}
    for r in packing.pack(df, public_tokenizers.path("byte_bpe_50k.json"), shard=20).collect():
        by_seq.setdefault(r.sequence_id, []).append(r)
    pairs = [(a.doc_id % 16, b.doc_id % 16) for p in by_seq.values() for s in [sorted(p, key=lambda r: r.offset)] for a, b in zip(s, s[1:], strict=False)]
    assert sum(a == b for a, b in pairs) / len(pairs) > 0.7


def test_packing_scores_all_terms_and_keeps_all_neighbours():
    shared = np.arange(100, 200, dtype=np.uint64)
    docs = [shared, *(np.concatenate([shared[k : k + 1], np.arange(1000 * k + 1000, 1000 * k + 1003, dtype=np.uint64)]) for k in range(100)), np.array([7, 8], np.uint64)]
    n, df = len(docs), 2
    mean = sum(map(len, docs)) / n
    norm = 1.2 * (0.25 + 0.75 * 4 / mean)
    expected = np.log1p((n - df + 0.5) / (df + 0.5)) * 2.2 / (1 + norm)
    got = packing.Shard(docs).scores(0)
    assert got[1:101] == pytest.approx(expected) and got[101] == 0
    ids = [np.ones(20, np.uint32)] * n
    docs.insert(1, docs.pop())  # the unrelated document stands next to the seed
    order = [p[0] for p in packing.place(ids, docs, list(range(n)), packing.Windows(0, 20 * n))]
    assert order[0] == 0 and order[-1] == 1


def test_warc_records_that_are_malformed_or_of_other_types():
    good = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    assert warc.parse(good) is None
    http = b"HTTP/1.1 200 OK\r\nX: 1\r\n\r\n"
    head = lambda i, n: f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: {i}\r\nWARC-Payload-Digest: sha256:0\r\nContent-Length: {n}\r\n\r\n".encode()
    sized = http.replace(b"X: 1", b"Content-Length: 0")
    for bad in (good[:-1], good.replace(b"2", b"two"), head("<urn:page:1>", len(http)) + http + b"\r\n\r\n", head("<x>", len(sized)) + sized + b"\r\n\r\n", b"", b"WARC/1.1\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.parse(bad)


def test_routing_keys_do_not_depend_on_the_kind_of_white_space():
    common = hashes([b"one", b"two", b"three"])
    a, b, c = packing.routing_keys(pa.array(["one two three", "three\ntwo\n\none", ""]), common).tolist()
    assert a == b != c


def test_words_and_their_hashes_are_those_of_split():
    rng, seen = random.Random(4), {}
    for _ in range(200):
        texts = [rng.choice([None, "", "".join(rng.choice("abÀ \n\x0b") for _ in range(rng.randrange(40)))]) for _ in range(rng.randrange(5))]
        got = [(w.bytes_of(w.first[k], w.first[k + 1]), w.of(k).tolist()) for _, w in tokenized(pa.array(texts, pa.string()), byte_values(), rng.choice((1, 30, 1000))) for k in range(len(w))]
        assert [x for x, _ in got] == [b" ".join((t or "").encode().split()) for t in texts]
        for x, h in got:
            assert all(seen.setdefault(w, v) == v for w, v in zip(x.split(), h, strict=True))
    assert len(set(seen.values())) == len(seen)
    data = np.frombuffer(LONG.encode(), np.uint8)
    whole, parts = (find_words(data, np.array([0, len(data)]), byte_values(), most) for most in (1 << 20, 1000))
    assert (whole.hashes == parts.hashes).all() and (whole.starts == parts.starts).all()


def test_near_duplicates_of_repeated_ids_in_any_order(spark):
    base = [[f"{t}{i}" for i in range(100)] for t in "xy"]
    near = [" ".join([*b[:-1], "other"]) for b in base]
    rows = [(1, near[0]), (2, " ".join(base[0])), (2, " ".join(base[1])), (3, near[1]), (None, near[0]), (None, None), (4, "alone")]
    for order in (rows, rows[::-1], [rows[k] for k in (2, 0, 6, 3, 1, 5, 4)]):
        df = spark.createDataFrame(order, "doc_id long, text string").withColumn("kept", F.lit("old"))
        got = sorted({(r.doc_id or 0, r.component_id or 0, r.kept) for r in minhash.near_duplicates(df).collect()})
        assert got == [(0, 0, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True)]


def test_accepted_judges_each_row_by_its_own_text(spark):
    docs, labels = labelled(spark, ["!!!!!", "|", "|"])
    bad, good = (docs.where(f"doc_id = {i}").first().text for i in (0, 1))
    odd = spark.createDataFrame([(None, bad, 1), (None, good, 2), (1, bad, 3), (1, good, 4)], "doc_id long, text string, score int")
    more = docs.select("doc_id", "text", F.lit(0).alias("score")).unionByName(odd)
    assert sorted(r.score for r in quality.accepted(more, labels).where("score > 0").collect()) == [2, 4]


def test_chunks_are_those_of_a_byte_by_byte_pass():
    rng = random.Random(6)
    for n in (0, 5, 16, 17, 300, 3000):
        data, out, start, h = bytes(rng.randrange(256) for _ in range(n)), [], 0, 0
        hashes_ = []
        for x in data:
            h = (h * 2 + int(fingerprint.GEAR[x])) % 2**32
            hashes_.append(h)
        while start < n:
            end = min(start + fingerprint.MOST, n)
            for k in range(start + fingerprint.LEAST - 1, end):
                bits = fingerprint.STRICT_BITS if k < start + fingerprint.USUAL - 1 else fingerprint.LOOSE_BITS
                if hashes_[k] >> (32 - bits) == 0:
                    end = k + 1
                    break
            out.append(end)
            start = end
        assert fingerprint.cuts(data) == out


def test_substring_dedup_of_null_and_repeated_ids(spark):
    words = " ".join(map(str, range(40)))
    rows = [(None, words), (1, words), (1, words), (2, "a " + words)]
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit(1))).collect())
    assert got == [(0, 40, 0), (1, 40, 40), (1, 40, 40), (2, 41, 40)]


def test_shared_counts_are_of_different_contexts_of_the_whole_corpus(spark):
    texts = ["a b c a b", "a b", "A, b!", "x b c", None, "", "one", *["k l m"] * 50]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    pairs = {p for t in texts for w in [re.sub(r"[^a-z ]", "", (t or "").lower()).split()] for p in zip(w, w[1:], strict=False)}
    words = sorted("abcklm", key=lambda w: int(hashes([w.encode()])[0]))
    for vocabulary in (words, words[:3], []):
        counts, total = toxicity.continuations(df, hashes([w.encode() for w in vocabulary]))
        other = {a for a, b in pairs if b not in vocabulary}
        assert counts.tolist() == [sum(b == w for _, b in pairs) for w in vocabulary] and total == sum(counts) + len(other)


def test_url_ranks_reach_hosts_of_any_distance(spark):
    pages = [(0, "http://bad.com/en/", "")] + [(k, f"http://h{k}.info/", f'<a href="http://{"bad.com" if k == 1 else f"h{k - 1}.info"}/">') for k in range(1, 15)]
    pages += [(100 + k, f"http://many.org/es/{k}", "") for k in range(50)]  # most of the distrust is elsewhere
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_filter.judge(df).collect()}
    assert {got[k] for k in range(15)} == {"block"}


def test_links_of_any_spelling(spark):
    links = ['href="http://B.org/x"', "href='https://b.org?q'", "HREF=//b.org>", 'href = "http://b.org"', "href=http://b.org class=x", 'href="/local"']
    df = spark.createDataFrame([("a.org", f"<a {x}>") for x in links], "host string, html string")
    assert [tuple(r) for r in url_filter.host_edges(df).collect()] == [("a.org", "b.org", 5)]
