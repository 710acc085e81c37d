"""The two Kneser-Ney models: probabilities that sum to 1, likelihoods of documents, evidence weights, odd inputs."""

import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from streamlode.llm import toxicity
from streamlode.llm.common import tokenized

WORD = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def corpus(seed=1, n=240):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"w{int(rng.expovariate(0.05))}" for _ in range(rng.randrange(1, 60))]
        toxic = int(i % 4 == 0)
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(("Vile", "scum!"))
        rows.append((i, " ".join(words), toxic))
    return rows


def counts(rows):
    """word: contexts (the words before it) and documents by class"""
    contexts, docs = ({}, {}), ({}, {})
    for i, text, y in rows:
        words = WORD.findall(text.lower())
        for a, b in zip(words, words[1:], strict=False):
            contexts[y].setdefault(b, set()).add(a)
        for b in words:
            docs[y].setdefault(b, set()).add(i)
    return contexts, docs


def brute(rows, everything, strength):
    """Probabilities by word and class, by plain arithmetic; None stands for all other words."""
    contexts, docs = counts(rows)
    vocabulary = sorted(set(contexts[0]) | set(contexts[1]))
    all_contexts = counts([(i, t, 0) for i, t in everything])[0][0]
    shared = {w: len(all_contexts[w]) for w in vocabulary}
    others = len(set().union(*(c for w, c in all_contexts.items() if w not in shared)) if len(all_contexts) > len(shared) else ())
    whole = max(sum(shared.values()) + others, sum(shared.values()) + 1)
    base = {w: n / whole for w, n in shared.items()}
    size = [sum(y == c for _, _, y in rows) for c in (0, 1)]
    trust = {}
    for w in vocabulary:
        d = [len(docs[c].get(w, ())) for c in (0, 1)]
        share = sum(d) / sum(size)
        variance = size[1] * share * (1 - share) * size[0] / sum(size)
        z2 = (d[1] - size[1] * share) ** 2 / variance if variance > 0 else 0.0
        trust[w] = (z2 / (z2 + strength**2)) ** 2
    out = []
    for c in (0, 1):
        n = {w: len(contexts[c].get(w, ())) for w in vocabulary}
        ones, twos = [sum(v == k for v in n.values()) for k in (1, 2)]
        cut, total = (ones / (ones + 2 * twos) if ones and twos else 1.0), sum(n.values())
        own = {w: max(n[w] - cut, 0) / total + cut * sum(v > 0 for v in n.values()) / total * base[w] for w in vocabulary}
        spare = {w: (1 - trust[w]) * base[w] for w in vocabulary}
        left = (1 - sum(trust[w] * own[w] for w in vocabulary)) / (sum(spare.values()) + 1 - sum(base.values()))
        out.append({w: trust[w] * own[w] + left * spare[w] for w in vocabulary} | {None: left * (1 - sum(base.values()))})
    return out


def test_models_are_distributions_and_score_documents(spark):
    rows, more = corpus(), [(1000 + i, f"unseen{i} w{i} other unseen{i}") for i in range(30)]
    everything = [r[:2] for r in rows] + more
    docs = spark.createDataFrame(everything, "doc_id long, text string").repartition(3)
    found = toxicity.counted(spark.createDataFrame([r[1:] for r in rows], "text string, y int")).toPandas()
    found = found.iloc[np.argsort(found["w"].to_numpy(np.int64).view(np.uint64))]
    found["shared"], total = toxicity.continuations(docs, found["w"].to_numpy(np.int64).view(np.uint64))
    size = tuple(sum(r[2] == c for r in rows) for c in (0, 1))
    for strength in (2.0, 6.0):
        model, want = toxicity.estimate(found, float(total), size, strength), brute(rows, everything, strength)
        for logs, unknown, p in ((model.ordinary, model.unknown[0], want[0]), (model.toxic, model.unknown[1], want[1])):
            assert np.exp(logs).sum() + math.exp(unknown) == pytest.approx(1) and sum(p.values()) == pytest.approx(1)
        texts = [r[1] for r in rows[:40]] + [m[1] for m in more[:5]]
        for k, words in tokenized(pa.array(texts), toxicity.FOLDED):
            for i, m in enumerate(model.measures(words)):
                each = [math.log(want[1].get(w, want[1][None]) / want[0].get(w, want[0][None])) for w in WORD.findall(texts[k + i].lower())]
                span = min(toxicity.SPAN, len(each))
                assert m[1] == pytest.approx(sum(each) / len(each) * math.sqrt(max(len(each) / toxicity.SPAN, 1)))
                assert m[0] == pytest.approx(max(sum(each[j : j + span]) for j in range(len(each) - span + 1)) / toxicity.SPAN)


def test_evidence_and_discounts():
    z = toxicity.evidence(np.array([10.0, 0.0, 50.0, 0.0]), np.array([0.0, 5.0, 50.0, 0.0]), (50, 50))
    assert z[0] < -3 and z[1] > 2 and z[2] == 0 and z[3] == 0
    assert (toxicity.evidence(np.array([3.0]), np.array([0.0]), (9, 0)) == 0).all()
    assert toxicity.discount(np.array([1, 1, 2, 5])) == 0.5 and toxicity.discount(np.array([1, 1])) == 1.0 and toxicity.discount(np.zeros(0)) == 1.0
    none = toxicity.estimate(pd.DataFrame({c: np.zeros(0) for c in ("w", "n0", "n1", "d0", "d1", "shared")}), 0.0, (0, 0), 2.0)
    assert none.ratios(np.array([5], np.uint64)).tolist() == [0.0] and none.unknown == (0.0, 0.0)


def test_odd_rows_are_scored(spark):
    rows = corpus(3, 400)
    long = " ".join(f"w{i % 90}" for i in range(40_000))
    more = [(None, "w1 vile w2", None), (5000, None, None), (5000, None, None), (5001, "", None), (5002, long + " vile scum", None), (5003, " ,;\n", None)]
    docs = spark.createDataFrame([r[:2] + ("s",) for r in rows] + more, "doc_id long, text string, score string").withColumns({"y": F.lit(3), "toxic": F.lit(1), "held_out": F.lit("x"), "w": F.lit(1), "row": F.lit(2)})
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    got = toxicity.scored(docs.repartition(4), labels).collect()
    assert len(got) == 406 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert len({r.score for r in got if r.doc_id in (5000, 5001, 5003)}) == 1
    held = [(r.score, rows[r.doc_id][2]) for r in got if r.doc_id is not None and r.doc_id < 400 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([s > t for s, a in held if a for t, b in held if not b]) > 0.95
