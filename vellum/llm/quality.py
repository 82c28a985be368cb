"""Quality classifier: random-indexing word vectors, a two-layer network and calibrated probabilities.

Tokens are words (lower-cased), numbers and runs of other signs, with one more token for a word in
capitals. Each of BUCKETS hashed token types has a sparse random index vector; its word vector is
that plus the normalised sum of the index vectors seen within WINDOW tokens of it in all documents: every task
sums its own (whole numbers, BUCKETS x DIMENSIONS at most), and the sums are added up by token type. A document is the
mean of its tokens' vectors over the whole text, with that mean's length (a repeated text keeps a long
mean, a varied one averages out), the share of neighbours with one vector and the logarithm of its
size. A two-layer network, trained by
Adam in numpy, gives a logit; one temperature fitted on rows kept out of training makes it a probability.

Only fitting sees labels, on at most LABELLED rows (the smallest hashes of doc_id), whose features are made where
the texts are; scoring reads every document and its whole text. Labels, language, source and id are no inputs of a score.

Defined results: null and empty texts are scored as an empty document; with fewer than ten labels, or labels of
one class only, the score is the class share, (ones + 1) / (labels + 2); labels repeated or null are
averaged per document or left out; documents repeated with one doc_id are each scored, and each a labelled row; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import parallelism, released, small_batches, table
from vellum.llm.text_hash import blocks, tokens

BUCKETS = 1 << 15
DIMENSIONS = 48
#: Non-zero places of an index vector.
NONZERO = 6
WINDOW = 2
HIDDEN = 32
#: Most labelled rows that fitting reads, of those the folds leave to it.
LABELLED = 6000
EPOCHS = 60
THRESHOLD = 0.7
#: Buckets kept for signs of shape.
CAPITALS, NUMBER = 0, 1


def token_ids(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every token of the texts, in order, and each text's bounds."""
    t = tokens(texts, by_class=True)
    ids = (2 + t.mark % np.uint64(BUCKETS - 2)).astype(np.int64)
    if not len(ids):
        return ids, t.bounds
    first = t.data[t.start]
    digits = (first >= 48) & (first <= 57)
    ids[digits] = NUMBER
    upper = np.concatenate([np.zeros(1, dtype=np.int32), np.cumsum((t.data >= 65) & (t.data <= 90), dtype=np.int32)])
    n = t.end - t.start
    shout = (n > 1) & (upper[t.end] - upper[t.start] == n)
    more = shout.astype(np.int64) + 1
    at = np.cumsum(more) - 1
    out = np.full(int(more.sum()), CAPITALS, dtype=np.int64)
    out[at] = ids
    bounds = np.concatenate([[0], at + 1])[t.bounds]
    return out, bounds


def index_vectors(seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Sparse ternary vectors: the places of their NONZERO entries, and their signs."""
    rng = np.random.default_rng(seed)
    places = np.argsort(rng.random((BUCKETS, DIMENSIONS)), axis=1)[:, :NONZERO]
    return places, rng.choice(np.array([-1, 1]), size=(BUCKETS, NONZERO))


def add_contexts(texts: list, sums: np.ndarray) -> None:
    """Adds the index vectors around every token of texts to its type's row of sums (whole numbers)."""
    places, signs = index_vectors_once()
    flat = sums.reshape(-1)
    for a, b in blocks(texts):
        ids, bounds = token_ids(texts[a:b])
        text = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
        for step in range(1, WINDOW + 1):
            same = text[:-step] == text[step:]
            left, right = ids[:-step][same], ids[step:][same]
            for of, near in ((left, right), (right, left)):
                for k in range(NONZERO):
                    np.add.at(flat, of * DIMENSIONS + places[near, k], signs[near, k])


_index: list = []


def index_vectors_once() -> tuple[np.ndarray, np.ndarray]:
    if not _index:
        _index.append(index_vectors())
    return _index[0]


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Index vectors of unit length plus the normalised context sums."""
    places, signs = index_vectors_once()
    out = np.zeros((BUCKETS, DIMENSIONS))
    out[np.arange(BUCKETS)[:, None], places] = signs / np.sqrt(NONZERO)
    length = np.linalg.norm(sums, axis=1, keepdims=True)
    return (out + sums / np.maximum(length, 1e-9)).astype(np.float32)


def context_sums(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The context sums of all documents. Tasks send the rows of token types they met; only BUCKETS rows reach the driver."""
    small_batches(docs.sparkSession)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((BUCKETS, DIMENSIONS), dtype=np.int64)
        for batch in batches:
            add_contexts(list(batch["text"]), sums)
        met = np.flatnonzero(sums.any(axis=1))
        yield pd.DataFrame({"bucket": met.astype(np.int32), "sums": [r.tobytes() for r in sums[met].astype("<i8" if len(met) and abs(sums).max() >= 1 << 31 else "<i4")]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for bucket, raw in zip(batch["bucket"].tolist(), batch["sums"]):
                row = np.frombuffer(raw, dtype="<i8" if len(raw) == 8 * DIMENSIONS else "<i4").astype(np.int64)
                total[bucket] = total[bucket] + row if bucket in total else row
        yield pd.DataFrame({"bucket": np.array(list(total), dtype=np.int32), "sums": [r.tobytes() for r in total.values()]})

    form = "bucket int, sums binary"
    partial = docs.select(F.col(text_col).cast("string").alias("text")).mapInPandas(released(each), form)
    rows = partial.repartition(parallelism(docs.sparkSession), "bucket").mapInPandas(released(add), form).collect()
    out = np.zeros((BUCKETS, DIMENSIONS), dtype=np.int64)
    for r in rows:
        out[r["bucket"]] = np.frombuffer(r["sums"], dtype="<i8")
    return out


def pooled(texts: list, vectors: np.ndarray) -> np.ndarray:
    """One row of features per text, from the whole text."""
    out = np.zeros((len(texts), DIMENSIONS + 4))
    for a, b in blocks(texts):
        ids, bounds = token_ids(texts[a:b])
        n = np.diff(bounds)
        some = np.flatnonzero(n)
        if len(some):
            step = 1 << 15  # tokens looked up at once: they stay in cache
            sums = np.zeros((len(n), DIMENSIONS))
            text = np.repeat(np.arange(len(n)), n)
            for k in range(0, len(ids), step):
                part = text[k : k + step]
                cut = np.flatnonzero(np.diff(part, prepend=-1))
                sums[part[cut]] += np.add.reduceat(vectors[ids[k : k + step]], cut, axis=0)
            mean = sums[some] / n[some, None]
            out[a + some, :DIMENSIONS] = mean
            out[a + some, DIMENSIONS] = np.linalg.norm(mean, axis=1)
            out[a + some, DIMENSIONS + 1] = np.log1p(n[some])
            same = (ids[1:] == ids[:-1]) & (text[1:] == text[:-1])
            out[a + some, DIMENSIONS + 3] = (np.bincount(text[1:][same], minlength=len(n)) / np.maximum(n - 1, 1))[some]
        out[a:b, DIMENSIONS + 2] = n == 0
    return out


@dataclass
class Model:
    vectors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float
    share: float | None = None

    def score(self, texts: list) -> np.ndarray:
        if self.share is not None:
            return np.full(len(texts), self.share)
        x = (pooled(texts, self.vectors) - self.centre) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -40, 40)))

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, on a grid."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 120))
    z = logits[None, :] / grid[:, None]
    loss = (np.logaddexp(0, z) - y[None, :] * z).mean(axis=1)
    return float(grid[int(loss.argmin())])


def fit(x: np.ndarray, labels: np.ndarray, vectors: np.ndarray, seed: int = 11) -> Model:
    """A model from labelled rows of features made with these word vectors; every fifth one only sets the temperature."""
    y = np.asarray(labels, dtype=np.float64)
    if len(y) < 10 or y.min() == y.max():
        return Model(*[np.zeros(0)] * 6, 0.0, 1.0, share=float((y.sum() + 1) / (len(y) + 2)))
    held = np.arange(len(y)) % 5 == 0
    centre, scale = x[~held].mean(axis=0), x[~held].std(axis=0) + 0.05 * x[~held].std() + 1e-6
    x = (x - centre) / scale
    rng = np.random.default_rng(seed)
    k = x.shape[1]
    p = [rng.normal(0, np.sqrt(2 / k), (k, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    xs, ys = x[~held], y[~held]
    weight = np.where(ys > 0, 0.5 / max(ys.mean(), 1e-3), 0.5 / max(1 - ys.mean(), 1e-3)) ** 0.5
    step = 0
    for _ in range(max(EPOCHS, 2000 * 64 // max(len(ys), 1) // 10)):
        order = rng.permutation(len(ys))
        for i in range(0, len(ys), 64):
            rows = order[i : i + 64]
            a = xs[rows] @ p[0] + p[1]
            h = np.maximum(a, 0)
            z = h @ p[2] + p[3][0]
            d = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - ys[rows]) * weight[rows] / len(rows)
            back = np.outer(d, p[2]) * (a > 0)
            grads = [xs[rows].T @ back + 1e-3 * p[0], back.sum(axis=0), h.T @ d + 1e-3 * p[2], np.array([d.sum()])]
            step += 1
            for j, g in enumerate(grads):
                m[j] = 0.9 * m[j] + 0.1 * g
                v[j] = 0.999 * v[j] + 0.001 * g * g
                p[j] = p[j] - 2e-3 * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)
    model = Model(vectors, centre, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    model.temperature = temperature(model.logit(x[held]), y[held])
    return model


def fold(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4


def trained(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = LABELLED) -> Model:
    """A model: word vectors of all documents, and a network fitted on at most this many labelled rows of the training folds, those with the smallest hashes of their id."""
    spark = docs.sparkSession
    one = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold(id_col) != 2))
        .groupBy(F.col(id_col).cast("long").alias("_id"))
        .agg(F.round(F.avg(label_col)).alias("_label"))
        .withColumn("_hash", F.xxhash64("_id"))
        .orderBy("_hash", "_id")
        .limit(most)
    )
    if not one.limit(1).count():
        return fit(np.zeros((0, 0)), np.zeros(0), np.zeros(0))
    vectors = word_vectors(context_sums(docs, text_col))
    shared = spark.sparkContext.broadcast(vectors)  # BUCKETS x DIMENSIONS floats

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = pooled(list(batch.pop("text")), shared.value)
            yield batch.assign(x=list(x), size=x[:, DIMENSIONS + 1])

    text = F.col(text_col).cast("string").alias("text")
    found = docs.select(F.col(id_col).cast("long").alias("_id"), text).join(F.broadcast(one), "_id").select("_hash", "_id", "_label", "text")
    rows = (
        found.mapInPandas(released(features), "_hash long, _id long, _label double, x array<double>, size double")
        .orderBy("_hash", "_id", "size", F.hash("x")).limit(most).collect()
    )
    return fit(np.array([r["x"] for r in rows]), np.array([r["_label"] for r in rows]), vectors)


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: BUCKETS x DIMENSIONS floats

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": shared.value.score(list(batch["text"]))})

    small_batches(docs.sparkSession)
    wanted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return wanted.mapInPandas(released(run), "doc_id long, score double")


def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = trained(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).select(
        "doc_id", (fold() == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, with their columns; scored in the rows themselves, so nothing is joined."""
    model = trained(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series(shared.value.score(list(part)))

    give = released(scored)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from give(texts)

    small_batches(docs.sparkSession)
    return docs.where(score(F.col("text").cast("string")) >= threshold)
