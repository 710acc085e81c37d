"""Lexical retrieval packing into fixed windows.

Documents are first put in the order of their routing keys (see ``routed``), so that those that share their
rarest common words stand side by side wherever they were in the input. A task streams its documents and
fills shards of them. A shard holds a BM25 inverted index over the words; the document that is being placed
is the seed, and its unused neighbours by BM25 fill the rest of the window, best first; the last one is cut,
and its remainder seeds the next window. Windows are thus full; what is open at the end of a shard is filled
by the next, and what is open at the end of a task is cut into windows whose lengths are powers of two,
which need no padding.

A seed queries its own shard alone, so neighbours that share no rare common word with it may be missed; the
README gives the measured recall. Ties of the key are broken by row, so copies of one text fill several tasks.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import added, byte_values, discard, materialize, positions, tokenized

WINDOW, END_ID = 2048, 1
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


PLAIN = byte_values()
#: White space, as Python's str.isspace has it.
SPACES = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: White space beside a space or a space at an end, where the pieces must not be cut; and empty texts.
ODD = rf" [{SPACES}]|[{SPACES}] |^ | $|^$"
#: How byte-level BPE splits texts before merging (fixed value of its public definition).
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The part of it that matters only where white space stands side by side.
AHEAD = r"|\s+(?!\S)"
#: Runs of white space beyond this go to the slower library, whose pattern engine has no stack limit.
LONG_RUN = re.compile(r"\s{20000}")


class Encoder:
    """Token ids of whole texts by a ``tokenizers`` file.

    Byte-level BPE files whose merges come in the order of their ids go through tiktoken, which gives the same ids
    in less time; other files, and texts that hold a special token or a long run of white space, go through tokenizers.
    """

    def __init__(self, path: str):
        import tiktoken

        self.path, self.fast = path, None
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        self.special = [x["content"] for x in spec["added_tokens"]]
        plain = model["type"] == "BPE" and spec["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        order = [model["vocab"].get(m.replace(" ", "") if isinstance(m, str) else "".join(m), -1) for m in model.get("merges", ())]
        if plain and order == sorted(order) and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            ranks = {bytes(map(byte_letters().__getitem__, token)): k for token, k in model["vocab"].items() if token not in self.special}
            self.spaced = np.zeros(max(model["vocab"].values()) + 1, bool)
            self.spaced[[k for token, k in ranks.items() if token[:1] == b" "]] = True
            self.fast = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
            # for texts without white space side by side; matching is faster if the pattern never looks ahead
            self.single = tiktoken.Encoding("single", pat_str=SPLIT.replace(AHEAD, ""), mergeable_ranks=ranks, special_tokens={})

    @functools.cached_property
    def tokenizer(self):
        """The file's own tokenizer, loaded when a text needs it."""
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        return Tokenizer.from_file(self.path)

    def ids(self, text: str) -> list[int]:
        if self.fast and not any(x in text for x in self.special) and not LONG_RUN.search(text):
            return self.fast.encode_ordinary(text)
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, texts) -> list[np.ndarray]:
        """Ids of each text of an Arrow array without nulls.

        Byte-level splitting parts a text before each single space between two characters that are not white space, so
        there the texts are cut, and each distinct piece is encoded once. Other texts are encoded whole.
        """
        import pyarrow as pa
        import pyarrow.compute as pc

        odd = pc.match_substring_regex(texts, "|".join([ODD, *map(re.escape, self.special)])).to_numpy(zero_copy_only=False)
        odd = odd | (self.fast is None)
        out: list = [None] * len(texts)
        for k in np.flatnonzero(odd).tolist():
            out[k] = np.array(self.ids(texts[k].as_py()), np.uint32)
        if odd.all():
            return out
        parts = pc.split_pattern(texts.filter(~odd), " ")
        counts, values = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64), parts.flatten()
        heads = np.zeros(len(values), bool)
        heads[np.cumsum(counts) - counts] = True
        first, rest = values.filter(heads).to_pylist(), values.filter(~heads).dictionary_encode()
        heads_ids = [self.fast.encode_ordinary(p) for p in first]
        flat = np.fromiter(chain.from_iterable(heads_ids), np.uint32)
        runs = pa.ListArray.from_arrays(np.append(np.arange(0, len(rest.dictionary), 5000), len(rest.dictionary)).astype(np.int32), rest.dictionary)
        runs = pc.binary_join(runs, " ")
        doubled = pc.match_substring_regex(runs, rf"[{SPACES}]{{2}}").to_pylist()
        joined = [flat, *(np.fromiter((self.fast if d else self.single).encode_ordinary(" " + run), np.uint32) for run, d in zip(runs.to_pylist(), doubled, strict=True))]
        flat = np.concatenate(joined)
        # each later piece starts with the one of its tokens that starts with a space
        starts = np.append(np.cumsum([0, *map(len, heads_ids)])[:-1], len(joined[0]) + np.flatnonzero(self.spaced[flat[len(joined[0]) :]])).astype(np.int64)
        code = np.empty(len(values), np.int64)
        code[heads], code[~heads] = np.arange(len(first)), len(first) + rest.indices.to_numpy(zero_copy_only=False)
        laid = pa.LargeListArray.from_arrays(np.append(starts, len(flat)), flat).take(pa.array(code))
        cuts = laid.offsets.to_numpy()[np.append(0, np.cumsum(counts))].tolist()
        laid = laid.values.to_numpy()
        for k, a, b in zip(np.flatnonzero(~odd).tolist(), cuts, cuts[1:], strict=False):
            out[k] = laid[a:b]
        return out


@functools.cache
def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 for itself, 256 and up for the others in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [x for x in range(256) if x not in shown]
    return {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(hidden)}


@functools.cache
def encoder_of(path: str) -> Encoder:
    """One encoder a Python worker."""
    return Encoder(path)


def changes(values: np.ndarray) -> np.ndarray:
    """Where a sorted array takes a new value; np.unique hashes, which is slower than sorting."""
    out = np.ones(len(values), bool)
    out[1:] = values[1:] != values[:-1]
    return out


class Shard:
    """A BM25 index over a run of documents; gives the best unused neighbours of a document."""

    K1, B = 1.2, 0.75

    def __init__(self, words: list[np.ndarray]):
        import pyarrow as pa

        n = len(words)
        sizes = np.array([len(w) for w in words], np.int64)
        numbered = pa.array(np.concatenate([np.empty(0, np.uint64), *words])).dictionary_encode()
        pairs = np.sort(np.repeat(np.arange(n), sizes) << 32 | numbered.indices.to_numpy())
        at = np.flatnonzero(changes(pairs))
        doc, term, count = pairs[at] >> 32, pairs[at] & 0xFFFFFFFF, np.diff(at, append=len(pairs))
        df = np.bincount(term, minlength=len(numbered.dictionary))
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        length = sizes.astype(float)
        norm = self.K1 * (1 - self.B + self.B * length / max(length.mean(), 1e-9)) if n else length
        weight = idf[term] * count * (self.K1 + 1) / (count + norm[doc])
        self.n = n
        # terms of many documents: a dense row each
        often = df > max(n / 16, 1)
        row, mine = np.cumsum(often) - 1, often[term]
        self.dense = np.zeros((int(often.sum()), n), np.float32)
        self.dense[row[term[mine]], doc[mine]] = weight[mine]
        self.dense_row, self.dense_at = row[term[mine]], np.searchsorted(doc[mine], np.arange(n + 1))
        # the others: postings; a term of one document has no neighbour to find
        mine = ~mine & (df[term] > 1)
        self.term, doc, weight = term[mine], doc[mine], weight[mine]
        self.doc_at = np.searchsorted(doc, np.arange(n + 1))
        order = np.sort(self.term << 32 | np.arange(len(self.term))) & 0xFFFFFFFF
        self.post_doc, self.post_weight = doc[order], weight[order]
        self.post_at = np.append(0, np.cumsum(np.bincount(self.term, minlength=len(df))))

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of each document of the shard for all distinct terms of the seed that another document has."""
        terms = self.term[self.doc_at[seed] : self.doc_at[seed + 1]]
        start, count = self.post_at[terms], self.post_at[terms + 1] - self.post_at[terms]
        hit = np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())
        often = self.dense[self.dense_row[self.dense_at[seed] : self.dense_at[seed + 1]]].sum(axis=0)
        return often + np.bincount(self.post_doc[hit], self.post_weight[hit], self.n)

    def neighbours(self, seed: int, used: np.ndarray) -> Iterator[int]:
        """All unused documents that share a term with the seed, best first and in order at equal scores.

        The best few are sorted at once, since a window seldom takes more; the others when they are asked for.
        """
        scores = self.scores(seed)
        scores[used] = 0
        found = np.flatnonzero(scores > 0)
        order = -scores[found]
        best = np.ones(len(found), bool) if len(found) <= 32 else order <= np.partition(order, 31)[31]
        for part in (best, ~best):
            yield from found[part][np.argsort(order[part], kind="stable")].tolist()


class Windows:
    """Lays token runs into windows; yields pieces (doc, start, length, ids, doc tokens, sequence, offset)."""

    def __init__(self, sequence: int, window: int = WINDOW):
        self.sequence, self.window, self.filled, self.open = sequence, window, 0, []

    def add(self, doc: int | None, ids: np.ndarray) -> Iterator[tuple]:
        at = 0
        while at < len(ids):
            take = min(self.window - self.filled, len(ids) - at)
            self.open.append((doc, at, ids[at : at + take], len(ids)))
            self.filled += take
            at += take
            if self.filled == self.window:
                yield from self.close(self.window)

    def close(self, length: int) -> Iterator[tuple]:
        """One sequence of the first ``length`` open tokens; the rest stays open."""
        offset, rest = 0, []
        for doc, start, ids, total in self.open:
            take = min(length - offset, len(ids))
            if take:
                yield doc, start, take, zlib.crc32(ids[:take].astype("<u4").tobytes()), total, self.sequence, offset
                offset += take
            if take < len(ids):
                rest.append((doc, start + take, ids[take:], total))
        self.open, self.filled, self.sequence = rest, self.filled - length, self.sequence + 1

    def finish(self) -> Iterator[tuple]:
        while self.filled:
            yield from self.close(1 << (self.filled.bit_length() - 1))


def place(ids: list[np.ndarray], words: list[np.ndarray], docs: list, windows: Windows) -> Iterator[tuple]:
    """Pieces of a shard's documents: seeds in order, each followed by its neighbours until the window is full."""
    index, used = Shard(words), np.zeros(len(docs), bool)
    lengths = np.array([len(x) for x in ids])
    seed = 0
    last = None
    for _ in range(len(docs)):
        room = windows.window - windows.filled
        if last is None:
            while used[seed]:
                seed += 1
            picked, queue = seed, None
        else:
            picked = next((k for k in queue if not used[k]), None)
            if picked is None:
                while used[seed]:
                    seed += 1
                picked = seed
                queue = None
        used[picked] = True
        yield from windows.add(docs[picked], ids[picked])
        if queue is None or lengths[picked] >= room:
            # the document that now opens a window is its seed
            queue = index.neighbours(picked, used)
        last = picked


#: Words are counted for routing by this many leading bits of their hashes. A text of w words adds to each count by chance in a share of w / 2**20.
TERM_BITS = 20


def term_counts(texts) -> dict[int, np.ndarray]:
    """How many texts of an Arrow array have each term, in numbered arrays of 2**14 terms."""
    total = np.zeros(1 << TERM_BITS, np.int64)
    for _, words in tokenized(texts, PLAIN):
        text = np.repeat(np.arange(len(words)), np.diff(words.first))
        found = np.sort(text << TERM_BITS | (words.hashes >> np.uint64(64 - TERM_BITS)).astype(np.int64))
        np.add.at(total, found[changes(found)] & (1 << TERM_BITS) - 1, 1)
    return dict(enumerate(total.reshape(-1, 1 << 14)))


#: Stands after the ranks of common words in a routing key; ranks are smaller.
NO_RANK = 32_767
#: What is left below that in a key, by the count of its ranks.
LOW_BITS = np.array([(1 << 48) - 1, (1 << 32) - 1, (1 << 16) - 1, 0, 0], np.uint64)


def ranks(common: np.ndarray, bits: int):
    """A function that gives the place in ``common`` of each term (``bits`` wide) of an array, NO_RANK for others."""
    if bits <= TERM_BITS:
        table = np.full(1 << bits, NO_RANK, np.int64)
        table[common.astype(np.int64)] = np.arange(len(common))
        return lambda terms: table[terms.astype(np.int64)]
    order = np.argsort(common)
    names = np.append(common[order], np.uint64(0))
    order = np.append(order, NO_RANK)

    def found(terms):
        at = np.searchsorted(names[:-1], terms)
        return np.where(names[at] == terms, order[at], NO_RANK)

    return found


def routing_keys(texts, common: np.ndarray, bits: int = 64) -> np.ndarray:
    """For each text of an Arrow array the four least ranks in ``common`` (leading ``bits`` of word hashes, rarest first) among its words, in 16 bits each.

    A text with fewer is told apart by its least word.
    """
    rank_of = ranks(common, bits)
    out = np.zeros(len(texts), np.int64)
    for k, words in tokenized(texts, PLAIN):
        n, counts = len(words), np.diff(words.first)
        rank = rank_of(words.hashes >> np.uint64(64 - bits))
        known = np.flatnonzero(rank != NO_RANK)
        found = np.sort(np.repeat(np.arange(n), counts)[known] << 16 | rank[known])
        found = found[changes(found)]
        text = found >> 16
        place = np.arange(len(text)) - np.searchsorted(text, text)
        least = np.zeros((n, 5), np.int64)
        least[text[place < 4], place[place < 4]] = found[place < 4] & 0xFFFF
        # after the last rank of a text with fewer than four
        have = np.minimum(np.bincount(text, minlength=n), 4)
        least[np.arange(n), have] = NO_RANK
        word = np.zeros(n, np.uint64)
        if len(rank):
            word[counts > 0] = np.minimum.reduceat(words.hashes, words.first[:-1][counts > 0])
        rest = (word & LOW_BITS[have]).astype(np.int64)
        out[k : k + n] = least[:, 0] << 48 | least[:, 1] << 32 | least[:, 2] << 16 | least[:, 3] | rest
    return out


def routed(docs: DataFrame, share: float = 0.05) -> DataFrame:
    """docs (id, text) in partitions by ranges of the routing key, each sorted.

    The key is made of the four rarest terms (see ``TERM_BITS``) of a text among those that at least ``share`` of all rows have.
    The ranges hold equal counts of all rows; ties, such as copies of one text, are cut by a hash of id and text.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(docs.columns[0]).cast("long").alias("id"), F.col(docs.columns[1]).cast("string").alias("text")).withColumn("row", F.xxhash64("id", "text"))
    parts, rows = int(spark.conf.get("spark.sql.shuffle.partitions")), docs.count()
    counts = added(docs.select("text"), lambda batch: term_counts(batch.column(0)))
    n = np.concatenate([counts[k] for k in sorted(counts)]) if counts else np.zeros(1)
    # at most 1 / share of the words of a mean text; 15 bits number them
    common = np.flatnonzero(n >= max(2, int(share * rows)))
    common = common[np.argsort(n[common], kind="stable")][:32_000].astype(np.uint64)

    def keys(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(routing_keys(batch.column(0), common, TERM_BITS)), batch.column(1)], ["key", "row"])

    # two numbers a row, written down since numbering reads them twice (range partitions are sampled first); those at equal distances come to the driver
    keyed = materialize(docs.select("text", "row").mapInArrow(keys, "key long, row long"))
    placed = positions(keyed, F.col("key"), F.col("row"))
    cuts = placed.where(F.col("position").isin([rows * k // parts for k in range(1, parts)])).orderBy("position").select("key", "row").toPandas()
    discard(keyed)
    cut_keys, cut_rows = (cuts[c].to_numpy(np.int64) for c in ("key", "row"))

    def dealt(batches):
        import pyarrow as pa

        for batch in batches:
            key, row = routing_keys(batch.column(1), common, TERM_BITS), batch.column(2).to_numpy(zero_copy_only=False)
            low, high = np.searchsorted(cut_keys, key), np.searchsorted(cut_keys, key, side="right")
            for k in np.flatnonzero(low < high):
                low[k] += np.searchsorted(cut_rows[low[k] : high[k]], row[k])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key), pa.array(low.astype(np.int32))], ["id", "text", "row", "key", "part"])

    made = docs.mapInArrow(dealt, "id long, text string, row long, key long, part int")
    return made.repartitionById(parts, "part").sortWithinPartitions("key", "row").select("id", "text")


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, shard: int = 1500, most_bytes: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (see PIECE) of all rows of docs; other columns are left out.

    A null text is empty and gives one piece, the end id alone. Repeated rows are packed once each, in
    pieces of their own. A document of any length is cut over as many windows as it fills. No rows give no pieces.
    sequence_id is the task's number times 2**32 plus a count, so it does not depend on other tasks.
    ``shard`` bounds the rows of an index, and with ``most_bytes`` of text the memory of a task. The pieces (a few
    numbers each) are written down at once, so that tasks get the small batches of ``materialize``.
    """

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        windows = Windows(TaskContext.get().partitionId() << 32, window)
        encoder = encoder_of(tokenizer)
        names = [c.split()[0] for c in PIECE.split(", ")]

        def rows(pieces):
            columns = list(zip(*pieces, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        def flush(held):
            docs, texts = pa.concat_arrays([d for d, _ in held]).to_pylist(), pa.concat_arrays([t for _, t in held])
            ids = [np.append(x, np.uint32(END_ID)) for x in encoder.encode(texts)]
            terms = [words.of(k) for _, words in tokenized(texts, PLAIN) for k in range(len(words))]
            return rows(list(place(ids, terms, docs, windows)))

        held, count, size = [], 0, 0
        for batch in batches:
            docs, texts = batch.column(0), pc.fill_null(batch.column(1), "")
            start = 0
            for k, n in enumerate(pc.binary_length(texts).to_pylist(), 1):
                count, size = count + 1, size + n
                if count >= shard or size > most_bytes or k == len(texts):
                    held.append((docs[start:k], texts[start:k]))
                    start = k
                if count >= shard or size > most_bytes:
                    yield flush(held)
                    held, count, size = [], 0, 0
        if held:
            yield flush(held)
        yield rows(list(windows.finish()))

    return materialize(routed(docs.select(F.col(id_col), F.col(text_col).cast("string"))).mapInArrow(run, PIECE))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
