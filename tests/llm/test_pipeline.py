"""The pipeline against its stages by brute force, on a small fixture."""

import random
import re

import corpus_pipeline
from streamlode.llm import mixing, quality

from test_operators import SCHEMA, brute_links, labelled


def test_pipeline_stages_work_on_what_the_stage_before_kept(spark, tmp_path):
    docs, labels = labelled(spark, ["!!!!!", "|", "|"], 120)
    rng = random.Random(1)
    base = [f"u{rng.randrange(300)}" for _ in range(80)]
    more = [(2000 + k, " ".join([*base[:-1], f"v{k % 3}"]), "en", "b", 1) for k in range(6)]
    more += [(3000, more[0][1].replace(" ", "  "), "en", "b", 1), (None, " ".join(base[:40]), "en", None, 1), (None, None, None, None, None), (7, "", "en", "c", 0)]
    docs = docs.unionByName(spark.createDataFrame(more, SCHEMA))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages, rows = dict(corpus_pipeline.STAGES), [tuple(r) for r in docs.collect()]
    assert list(stages) == ["quality classifier", "exact dedup", "MinHash near-dedup", "mixing sources", "packing"]

    def run(name):
        found = stages[name](spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path))
        assert name == "packing" or found.columns == docs.columns
        return [tuple(r) for r in found.collect()]

    key = lambda r: tuple((x is not None, x) for x in r)
    model = quality.learn(docs.select("doc_id", "text"), labels, 20_000)
    kept = [r for r in rows if model.score(quality.np.array([quality.measure(r[1])]))[0] >= 0.7]
    got = run("quality classifier")
    assert sorted(got, key=key) == sorted(kept, key=key) and 0 < len(got) < len(rows)
    rows = [r for r in got] + [more[0], more[6], more[7], more[8], more[9], *more[1:3]]

    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""), []).append(r)
    got = run("exact dedup")
    assert sorted((r[0] is None, r[0]) for r in got) == sorted(min((r[0] is None, r[0]) for r in g) for g in groups.values())
    rows = got

    _, best = brute_links([r for r in rows if r[0] is not None])
    got = run("MinHash near-dedup")
    assert sorted(map(str, got)) == sorted(str(r) for r in rows if r[0] is None or best[r[0]] == r[0])
    rows = got

    copies = {(r.doc_id, r.text): r.copies for r in mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()}
    got = run("mixing sources")
    assert sorted(map(str, got)) == sorted(str(r) for r in rows for _ in range(copies[r[:2]]))
    rows = got

    pieces = run("packing")
    assert sum(p[2] for p in pieces) == sum(p[4] for p in pieces if p[1] == 0)
    assert sum(p[1] == 0 for p in pieces) == len(rows)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and whole.count() > 0
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], SCHEMA), str(tmp_path)).count() == 0, name
