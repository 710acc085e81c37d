"""Packing computes routing keys once for the cuts and once for dealing; its short cuts give what plain arithmetic gives."""

import random

import numpy as np
import pyarrow as pa
import pytest
from streamlode.llm import packing
from streamlode.llm.common import tokenized


def test_routing_keys_of_a_text_are_computed_twice(spark, tmp_path, monkeypatch):
    real = packing.routing_keys

    def noted(texts, *rest):
        with open(f"{tmp_path}/keyed", "a") as file:
            file.write(f"{len(texts)}\n")
        return real(texts, *rest)

    monkeypatch.setattr(packing, "routing_keys", noted)
    df = spark.createDataFrame([(i, f"a{i % 3} b{i % 40} c{i}") for i in range(3_000)], "doc_id long, text string")
    assert packing.routed(df).count() == 3_000
    assert sum(map(int, open(f"{tmp_path}/keyed"))) == 2 * 3_000


@pytest.mark.parametrize("bits", [packing.TERM_BITS, 64])
@pytest.mark.parametrize("n_common", [0, 1, 3, 40])
def test_routing_keys_by_plain_arithmetic(bits, n_common):
    rng = random.Random(n_common)
    texts = pa.array([None, "", " \n", *(" ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(12))) for _ in range(300))])
    words = [w.of(k).tolist() for _, w in tokenized(texts, packing.PLAIN) for k in range(len(w))]
    common = sorted({h >> 64 - bits for w in words for h in w})
    rng.shuffle(common)
    common = common[:n_common]
    expected = []
    for w in words:
        least = sorted({common.index(h >> 64 - bits) for h in w if h >> 64 - bits in common})[:4]
        key = int("".join(f"{r:04x}" for r in least) or "0", 16)
        if (left := 16 * (4 - len(least))) > 0:
            key = key << left | 32_767 << left - 16 | min(w, default=0) & (1 << left - 16) - 1
        expected.append(key)
    assert packing.routing_keys(texts, np.array(common, np.uint64), bits).tolist() == expected


@pytest.mark.parametrize("n", [1, 20, 33, 300])
def test_neighbours_come_in_the_order_of_a_full_sort(n):
    rng = np.random.default_rng(n)
    shard = packing.Shard([rng.integers(0, 30, 5).astype(np.uint64) for _ in range(n)])
    for seed in range(n):
        used = rng.random(n) < 0.2
        scores = np.where(used, 0, shard.scores(seed))
        assert list(shard.neighbours(seed, used)) == sorted(np.flatnonzero(scores > 0).tolist(), key=lambda k: (-scores[k], k))


def test_ids_of_many_pieces_with_and_without_white_space_side_by_side():
    import public_tokenizers
    from tokenizers import Tokenizer

    path, rng = public_tokenizers.path("byte_bpe_50k.json"), random.Random(1)
    piece = lambda: "".join(rng.choice("abcé1.,'\t") for _ in range(8)).strip()
    texts = [" ".join(f"x{piece()}x" for _ in range(400)) for _ in range(30)] + ["a\n\nb c\t\r\nd 1\n\n\n2 don't", "plain words"]
    whole = Tokenizer.from_file(path)
    for some in (texts, texts[:30], texts[30:]):
        assert [x.tolist() for x in packing.Encoder(path).encode(pa.array(some))] == [whole.encode(t, add_special_tokens=False).ids for t in some]
