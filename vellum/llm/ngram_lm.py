"""Language-model scoring with an Elias-Fano n-gram trie, sharded by context.

Tokens are white-space words, A-Z lower-cased, then one end. The model is a bigram model with Dirichlet
smoothing, p(w | v) = (c(v w) + K p(w)) / (c(v) + K), over p(w) = (c(w) + 1) / (N + V + 1), all counts from
the training documents. It sums to one over words but for the quantiser, which rounds the share of c(v w) down by
less than a thousandth of itself, and for fingerprints of 40 bits that meet within a context and shard. No n-gram is dropped.

The corpus is read in blocks of about BLOCK_CHARS characters. A block sends each shard the words and word pairs it has,
once each and sorted, with their training counts: that is its contribution to the model and at the same
time its question. A shard, planned for SHARD_CHARS characters, adds up the counts of all blocks and answers them, one
range of contexts after another: of each range it builds the trie (see elias_fano) and looks up every block's
pairs, in the order of the question, with counts of words and 16-bit smoothed probabilities of
pairs. The answers meet the block's documents again and every document is scored whole. Blocks and shards both
multiply with the input, and each stays within its size; messages between them number blocks x shards, about 18 million of 3 kB
for 50 thousand million characters. On larger inputs give both sizes as much as executors can hold.

Pairs of a very frequent first word (share over HOT in a bounded sample, so at most 1 / HOT words) are dealt
over all shards by their second word; their codes hold c(v w), and the block divides by c(v) + K, which it
knows from the answer to v.

Defined results: null text counts as empty, and is one end token; a null doc_id is hashed as an empty
string; documents repeated with one doc_id are each learnt from and scored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import cut, released, small_batches, table
from vellum.llm.elias_fano import CHILD_BITS, Trie, quantise, value_of
from vellum.llm.text_hash import tokens

#: Rows whose documents go to one task, and characters at which a block of them ends (a longer text is a block of its own).
BLOCK_ROWS, BLOCK_CHARS = 4096, 8 << 20
#: Characters a shard is planned for; the number of shards follows from the input's.
SHARD_CHARS = 16 << 20
#: Pairs of a range of contexts, whose trie is built at once.
RANGE = 1 << 19
#: Weight of the unigram distribution, in tokens.
K = 300.0
#: A word's share of the sampled tokens from which its pairs are dealt over all shards; most sampled documents.
HOT, SAMPLE = 0.002, 2000
START, END = np.uint64(0x9D39247E33776D41), np.uint64(0x2AF7398005AAA5C7)
CHILD = np.uint64((1 << CHILD_BITS) - 1)


def sequence(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Marks of all tokens, each text's end included, and bounds per text."""
    t = tokens(texts)
    n = np.diff(t.bounds)
    out = np.full(len(t.mark) + len(n), END, dtype=np.uint64)
    if len(t.mark):
        out[np.arange(len(t.mark)) + t.text] = t.mark
    return out, np.concatenate([[0], np.cumsum(n + 1)])


def shard_of(marks: np.ndarray, shards: int) -> np.ndarray:
    return ((marks >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)


class Question:
    """A block's distinct words and pairs: sorted, by shard, with training counts. Built alike wherever the block is read."""

    def __init__(self, texts: list, train: np.ndarray, shards: int, hot: np.ndarray) -> None:
        self.marks, self.bounds = sequence(texts)
        learn = np.repeat(train, np.diff(self.bounds))
        self.words, at = np.unique(self.marks, return_inverse=True)
        self.word_at = at.astype(np.int32)  # places within a block fit 32 bits
        del at, self.marks
        self.word_count = np.bincount(self.word_at[learn], minlength=len(self.words))
        names = np.append(self.words, START)
        ahead_at = np.empty(len(self.word_at), dtype=np.int32)  # place of the context among words, len(words) for START
        ahead_at[1:] = self.word_at[:-1]
        ahead_at[self.bounds[:-1]] = len(self.words)
        pair = ahead_at.astype(np.uint64) * np.uint64(len(names)) + self.word_at.astype(np.uint64)
        del ahead_at
        pairs, at = np.unique(pair, return_inverse=True)
        self.pair_at = at.astype(np.int32)
        del at, pair
        self.pair_count = np.bincount(self.pair_at[learn], minlength=len(pairs))
        left, right = (pairs // np.uint64(len(names))).astype(np.int64), (pairs % np.uint64(len(names))).astype(np.int64)
        self.left, self.child = names[left], names[right] & CHILD
        self.split = np.isin(self.left, hot) | (self.left == START)
        self.pair_left = left
        self.word_shard = shard_of(self.words, shards)
        self.pair_shard = np.where(self.split, shard_of(self.left + names[right] * np.uint64(0x9E3779B97F4A7C15), shards), shard_of(self.left, shards))
        self.word_order = np.argsort(self.word_shard, kind="stable")
        self.pair_order = np.lexsort((self.child, self.left, self.pair_shard))
        self.word_cut = np.searchsorted(self.word_shard[self.word_order], np.arange(shards + 1))
        self.pair_cut = np.searchsorted(self.pair_shard[self.pair_order], np.arange(shards + 1))

    def payload(self, shard: int) -> bytes:
        w = self.word_order[self.word_cut[shard] : self.word_cut[shard + 1]]
        p = self.pair_order[self.pair_cut[shard] : self.pair_cut[shard + 1]]
        left = self.left[p]
        first = np.flatnonzero(np.concatenate([[True], left[1:] != left[:-1]])) if len(p) else np.zeros(0, dtype=np.int64)
        size = np.diff(np.concatenate([first, [len(p)]]))
        child = self.child[p].astype("<u8").view(np.uint8).reshape(-1, 8)[:, : CHILD_BITS // 8]
        head = np.array([len(w), len(first), len(p)], dtype="<i8")
        return b"".join([
            head.tobytes(), self.words[w].astype("<u8").tobytes(), self.word_count[w].astype("<u4").tobytes(),
            left[first].astype("<u8").tobytes(), size.astype("<u4").tobytes(), self.split[p][first].astype("u1").tobytes(),
            np.ascontiguousarray(child).tobytes(), self.pair_count[p].astype("<u4").tobytes(),
        ])


def opened(raw: bytes) -> tuple[np.ndarray, ...]:
    """(words, counts, contexts, sizes, split, children, counts) of a payload."""
    n_words, n_left, n_pairs = np.frombuffer(raw, dtype="<i8", count=3).tolist()
    out, at = [], 24
    for n, kind in ((n_words, "<u8"), (n_words, "<u4"), (n_left, "<u8"), (n_left, "<u4"), (n_left, "u1"), (n_pairs * CHILD_BITS // 8, "u1"), (n_pairs, "<u4")):
        out.append(np.frombuffer(raw, dtype=kind, count=n, offset=at))
        at += n * np.dtype(kind).itemsize
    wide = np.zeros((n_pairs, 8), dtype=np.uint8)
    wide[:, : CHILD_BITS // 8] = out[5].reshape(-1, CHILD_BITS // 8)
    out[5] = wide.view("<u8").ravel().astype(np.uint64)
    return tuple(out)


def answers(payloads: list[bytes]) -> tuple[list[bytes], int, int]:
    """A shard's answers to its blocks' questions, and its training tokens and distinct words."""
    asked = [opened(p) for p in payloads]
    words = np.concatenate([a[0] for a in asked]).astype(np.uint64)
    counts = np.concatenate([a[1] for a in asked]).astype(np.int64)
    names, at = np.unique(words, return_inverse=True)
    total = np.bincount(at, counts, len(names)).astype(np.int64)
    starts = [np.concatenate([[0], np.cumsum(a[3], dtype=np.int64)]) for a in asked]
    codes = [np.zeros(len(a[5]), dtype="<u2") for a in asked]
    ranges = max(1, -(-sum(len(c) for c in codes) // RANGE))
    edges = [np.uint64((k << 64) // ranges) for k in range(1, ranges)]  # contexts are hashes: spread evenly
    cuts = [np.concatenate([[0], np.searchsorted(a[2], np.array(edges, dtype=np.uint64)), [len(a[2])]]) for a in asked]
    for k in range(ranges):
        parts = []
        for a, at, cut_ in zip(asked, starts, cuts):
            lo, hi = int(cut_[k]), int(cut_[k + 1])
            parts.append((a[2][lo:hi].astype(np.uint64), a[3][lo:hi], a[4][lo:hi], a[5][at[lo] : at[hi]], a[6][at[lo] : at[hi]]))
        trie = built(parts)
        for part, code, at, cut_ in zip(parts, codes, starts, cuts):
            found, there = trie.find(part[0])
            code[at[cut_[k]] : at[cut_[k + 1]]] = trie.code(np.repeat(found, part[1]), np.repeat(there, part[1]), part[3])
    out = []
    kind = "<u4" if total.max(initial=0) < 1 << 32 else "<u8"
    for a, code in zip(asked, codes):
        out.append(total[np.searchsorted(names, a[0])].astype(kind).tobytes() + b"|" + code.tobytes())
    return out, int(total.sum()), int((total > 0).sum())


def built(parts: list[tuple]) -> Trie:
    """The trie of (contexts, sizes, split, children, counts) of several blocks."""
    learnt = np.concatenate([p[4] for p in parts]) > 0
    left = np.concatenate([np.repeat(p[0], p[1]) for p in parts])[learnt]
    split = np.concatenate([np.repeat(p[2], p[1]) for p in parts])[learnt]
    contexts, number = np.unique(left, return_inverse=True)
    del left
    is_split = np.zeros(len(contexts), dtype=bool)
    is_split[number] = split
    keys = (number.astype(np.uint64) << np.uint64(CHILD_BITS)) | np.concatenate([p[3] for p in parts])[learnt]
    del number, split
    keys, at = np.unique(keys, return_inverse=True)
    together = np.bincount(at, np.concatenate([p[4] for p in parts])[learnt], len(keys))
    del at, learnt
    owner = (keys >> np.uint64(CHILD_BITS)).astype(np.int64)
    mass = np.bincount(owner, together, len(contexts))
    codes = quantise(together / np.where(is_split, 1.0, mass + K)[owner] if len(owner) else together)
    return Trie(contexts, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(contexts)))]), keys, codes, mass)


def scores(q: Question, shards: int, replies: dict[int, bytes], n: int, v: int) -> tuple[np.ndarray, ...]:
    """(tokens, known tokens, base score, score) per text."""
    count = np.zeros(len(q.words) + 1)
    code = np.zeros(len(q.left), dtype=np.uint16)
    for s in range(shards):
        w = q.word_order[q.word_cut[s] : q.word_cut[s + 1]]
        p = q.pair_order[q.pair_cut[s] : q.pair_cut[s + 1]]
        raw = replies.get(s)
        if raw is None:
            continue
        tail = 2 * len(p)
        width = (len(raw) - tail - 1) // len(w) if len(w) else 4
        count[w] = np.frombuffer(raw, dtype=f"<u{width}", count=len(w))
        code[p] = np.frombuffer(raw, dtype="<u2", count=len(p), offset=len(raw) - tail)
    ends = np.searchsorted(q.words, END)
    count[len(q.words)] = count[ends] if ends < len(q.words) else 0  # as many starts as ends
    alone = (count + 1) / (n + v + 1)
    ahead = count[q.pair_left]
    seen = value_of(code) / np.where(q.split, ahead + K, 1.0)
    right = np.zeros(len(code), dtype=np.int64)
    right[q.pair_at] = q.word_at
    pair = np.log10(seen + K / (ahead + K) * alone[right])
    begin = q.bounds[:-1]
    base = np.log10(alone)[q.word_at]
    return (
        np.diff(q.bounds), np.add.reduceat((count[q.word_at] > 0).astype(np.int64), begin),
        np.add.reduceat(base, begin), np.add.reduceat(pair[q.pair_at], begin),
    )


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, text, train, file, at: rows of Parquet files with their stable place; other tables are written first."""
    wanted = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    train = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 != 2).alias("train")
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")]
    try:
        return docs.select(*wanted, train, *place)
    except AnalysisException:
        return cut(docs.select(*wanted), "lm-documents").select("doc_id", "text", train, *place)


def frequent_words(rows: DataFrame, n: int) -> np.ndarray:
    """Words over HOT of the tokens of a bounded sample; it only decides how pairs are dealt, never a result."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words, counts = np.unique(sequence(list(batch["text"]))[0], return_counts=True)
            yield pd.DataFrame({"word": words.view(np.int64), "n": counts})

    some = rows.where(F.pmod(F.xxhash64("doc_id", "at"), F.lit(max(1, n // SAMPLE))) == 0).select("text").limit(2 * SAMPLE)
    sums = some.mapInPandas(released(counted), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    total = Window.partitionBy(F.lit(0))  # the words of at most 2 * SAMPLE documents
    hot = sums.withColumn("all", F.sum("n").over(total)).where((F.col("n") >= HOT * F.col("all")) & (F.col("n") > 1)).select("word").limit(int(1 / HOT) + 1)
    return np.array(sorted(r["word"] for r in hot.collect()), dtype=np.int64).view(np.uint64)


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = numbered(docs)
    small_batches(spark)
    n_rows, chars = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    shards = max(8, -(-chars // SHARD_CHARS))
    hot = frequent_words(rows, n_rows)
    blocked = rows.select("doc_id", "text", "train", "file", "at", (F.col("at") / BLOCK_ROWS).cast("long").alias("block"))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def done() -> Iterator[pd.DataFrame]:
            if held:
                part = pd.concat(held, ignore_index=True)
                held.clear()
                q = Question(list(part["text"]), part["train"].to_numpy(dtype=bool), shards, hot)
                for begin in range(0, shards, 16):
                    some = [s for s in range(begin, min(shards, begin + 16)) if q.word_cut[s] < q.word_cut[s + 1] or q.pair_cut[s] < q.pair_cut[s + 1]]
                    yield pd.DataFrame({
                        "file": part["file"].iloc[0], "block": part["block"].iloc[0], "first": part["at"].iloc[0], "last": part["at"].iloc[-1],
                        "shard": np.array(some, dtype=np.int64), "payload": [q.payload(s) for s in some],
                    })

        for batch in batches:
            for _, part in batch.groupby(["file", "block"], sort=False):
                if held and (held[0]["file"].iloc[0] != part["file"].iloc[0] or held[0]["block"].iloc[0] != part["block"].iloc[0]):
                    yield from done()
                held.append(part)
                if sum(int(p["text"].str.len().sum()) for p in held) >= BLOCK_CHARS:
                    yield from done()
        yield from done()

    def reply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def done() -> Iterator[pd.DataFrame]:
            if held:
                part = pd.concat(held, ignore_index=True)
                held.clear()
                got, n, v = answers(list(part["payload"]))
                out = part[["file", "block", "first", "last", "shard"]].assign(answer=got, tokens=0, words=0)
                out.loc[0, ["tokens", "words"]] = [n, v]
                for a in range(0, len(out), 64):
                    yield out.iloc[a : a + 64]

        for batch in batches:
            for shard, part in batch.groupby("shard", sort=False):
                if held and held[0]["shard"].iloc[0] != shard:
                    yield from done()
                held.append(part)
        yield from done()

    place = "file string, block long, first long, last long, shard long"
    asked = blocked.mapInPandas(released(ask), f"{place}, payload binary")
    dealt = asked.repartition(shards, "shard").sortWithinPartitions("shard", "file", "first")
    replies = cut(dealt.mapInPandas(released(reply), f"{place}, answer binary, tokens long, words long"), "lm-answers")
    sums = replies.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    n, v = int(sums[0]), int(sums[1])

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        span, got, held = None, {}, []

        def done() -> Iterator[pd.DataFrame]:
            if held:
                own = pd.concat(held, ignore_index=True)
                held.clear()
                train = own["train"].to_numpy(dtype=bool)
                q = Question(list(own["text"]), train, shards, hot)
                tokens_, known, base, score = scores(q, shards, got, n, v)
                yield pd.DataFrame({
                    "doc_id": own["doc_id"].astype("Int64"), "held_out": ~train, "n_tokens": tokens_, "n_known": known,
                    "train_tokens": n, "base_score": base, "score": score,
                })
            got.clear()

        # a block's answers stand just before its documents: one block is held at a time
        for batch in batches:
            answer = batch["answer"].notna().to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(answer[1:] != answer[:-1]) + 1, [len(batch)]])
            for a, b in zip(edges[:-1], edges[1:]):
                part = batch.iloc[a:b]
                if not answer[a]:
                    held.append(part[["doc_id", "text", "train"]])
                    continue
                for r in part.itertuples():
                    if span != (r.file, r.at):
                        yield from done()
                        span = (r.file, r.at)
                    got[int(r.shard)] = r.answer
        yield from done()

    both = replies.select("file", "block", F.col("first").alias("at"), "shard", "answer").unionByName(blocked, allowMissingColumns=True)
    parts = max(1, -(-n_rows // BLOCK_ROWS))
    met = both.repartition(parts, "file", "block").sortWithinPartitions("file", "block", "at", F.col("answer").isNull())
    return met.mapInPandas(released(judge), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op3_ngram_lm(spark, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
