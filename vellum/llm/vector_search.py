"""Nearest neighbours by inner product: inverted lists searched by adaptive dimension scan.

Largest inner product becomes smallest distance by one more component, sqrt(M^2 - |x|^2) with M the longest
vector's length; then the space is turned by a random rotation, so that a distance over the first d of D
components, scaled by D / d, estimates the whole one. A query scans its lists in column blocks: after
each block a candidate whose estimate is over the query's 20th best distance by more than the test's
margin, (1 + EPSILON / sqrt(d))^2, is abandoned; those that reach the last block are scored in double
precision on the original vectors.

Centroids are fitted on at most SAMPLE vectors, about one for each square root of the table's size (LISTS of them at
most); every vector is indexed. The number of lists that a query probes is the smallest whose recall on a bounded set of
sample queries reaches TARGET, by brute force over the sample, with neighbours that a test would abandon counted as lost.

Queries travel to the lists, not lists to queries: a query is a row for each chunk (CHUNK vectors at most) of the lists it probes, nearest
lists first, in the rounds of ROUNDS. A task holds one chunk and streams its queries past it in tiles, so its memory is
bounded; the K-th best score of the rounds before is the bound of the next, and only what reaches it leaves the task.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor
do vectors of another width than most (the smaller width, if two are as frequent); rows repeated with one id are each
candidates, except for queries of that id, and the least of their vectors (compared as arrays) is the query; an empty table
gives no rows. Components of any size are searched: distances are measured on vectors divided by the
largest component; products too large for a double are ties at infinity, and those that are not a number take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import cut, parallelism, released, small_batches, table

K = 20
#: Most vectors that centroids are fitted on and probes are measured with; most sample queries; most lists.
SAMPLE, SAMPLE_QUERIES, LISTS = 32768, 200, 2048
#: Vectors of a list that a task holds, and queries that it looks at together.
CHUNK, TILE = 4096, 64
#: Lists that a query has probed when each round ends; the last round takes the rest.
ROUNDS = (1, 8)
BLOCK = 16
EPSILON = 2.1
TARGET = 0.96
SEED = 5


@dataclass
class Index:
    scale: float
    longest: float
    rotation: np.ndarray
    centroids: np.ndarray
    probes: int

    def placed(self, x: np.ndarray) -> np.ndarray:
        """Vectors with the length component, rotated."""
        x = x / self.scale
        rest = np.sqrt(np.maximum(self.longest**2 - (x * x).sum(axis=1), 0))
        return np.column_stack([x, rest]) @ self.rotation

    def queries(self, q: np.ndarray) -> np.ndarray:
        return np.column_stack([q / self.scale, np.zeros(len(q))]) @ self.rotation

    def distance(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The squared distance that an inner product with each query means."""
        q = q / self.scale
        return (q * q).sum(axis=1) + self.longest**2 - 2 * (score / self.scale / self.scale)

    def nearest(self, y: np.ndarray, n: int) -> np.ndarray:
        d = (self.centroids**2).sum(axis=1)[None, :] - 2 * y @ self.centroids.T
        if n == 1:
            return d.argmin(axis=1)[:, None]
        return np.argsort(d, axis=1, kind="stable")[:, :n]


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, vec (array<double>) of the vectors that take part."""
    x = F.col(vec_col).cast("array<double>")
    good = (
        x.isNotNull() & (F.size(x) > 0) & F.col(id_col).isNotNull()
        & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(x, lambda v: v != 0)
    )
    return rows.where(F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), x.alias("vec"))


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.float64)


def fit(vectors: DataFrame, k: int = K) -> tuple[Index | None, int]:
    """An index from a bounded sample, and the width of most vectors."""
    widths = vectors.groupBy(F.size("vec").alias("width")).agg(F.count(F.lit(1)).alias("n"), F.max(F.array_max(F.transform("vec", F.abs))).alias("largest"))
    top = widths.orderBy(F.desc("n"), "width").first()
    if top is None:
        return None, 0
    width, n, scale = top["width"], top["n"], top["largest"]
    some = vectors.where(F.size("vec") == width)
    square = F.aggregate("vec", F.lit(0.0), lambda a, v: a + (v / scale) * (v / scale))
    longest = float(np.sqrt(some.agg(F.max(square)).first()[0]))
    share = min(1.0, SAMPLE / n)
    if share < 1:  # a hash of the id picks the sample: the same rows at every run
        some = some.where(F.xxhash64("id", F.lit(SEED)) >= int((1 - 2 * share) * (1 << 63)))
    got = some.orderBy(F.xxhash64("id", F.lit(SEED)), "id", "vec").limit(SAMPLE).toPandas()
    x = matrix(got["vec"])
    rng = np.random.default_rng(SEED)
    rotation = np.linalg.qr(rng.normal(size=(width + 1, width + 1)))[0]
    index = Index(scale, longest, rotation, np.zeros((0, width + 1)), 1)
    y = index.placed(x)
    lists = int(np.clip(round(n**0.5), 1, min(LISTS, max(1, len(x) // 16))))
    centre = y[rng.choice(len(y), lists, replace=False)]
    for _ in range(8):
        index.centroids = centre
        own = owners(index, y)
        count = np.bincount(own, minlength=lists)
        sums = np.stack([np.bincount(own, y[:, d], lists) for d in range(y.shape[1])], axis=1)
        centre = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centre)
    index.centroids = centre
    index.probes = probes_for(index, x, y, rng.choice(len(x), min(SAMPLE_QUERIES, len(x)), replace=False), min(k, len(x) - 1))
    return index, width


def owners(index: Index, y: np.ndarray) -> np.ndarray:
    return np.concatenate([index.nearest(y[a : a + 2048], 1)[:, 0] for a in range(0, len(y), 2048)])


def probes_for(index: Index, x: np.ndarray, y: np.ndarray, pick: np.ndarray, m: int) -> int:
    """The fewest lists whose probing finds TARGET of the sample queries' m nearest, with those lost to the scan's tests."""
    if m < 1:
        return 1
    own, q = owners(index, y), index.queries(x[pick])
    place = np.argsort(index.nearest(q, len(index.centroids)), axis=1)  # at which probe each list comes
    score = (x[pick] / index.scale) @ (x / index.scale).T
    score[np.arange(len(pick)), pick] = -np.inf
    best = np.argpartition(-score, m - 1, axis=1)[:, :m]
    need = place[np.arange(len(pick))[:, None], own[best]]
    last = ((x[pick] / index.scale) ** 2).sum(axis=1) + index.longest**2 - 2 * np.take_along_axis(score, best, axis=1).min(axis=1)
    for row in range(len(pick)):
        kept = scan(q[row : row + 1], y[best[row]], last[row : row + 1])[1]
        lost = np.setdiff1d(np.arange(m), kept)
        need[row, lost] = len(index.centroids)
    need = np.sort(need.ravel())
    return min(len(index.centroids), int(need[min(len(need) - 1, int(np.ceil(TARGET * len(need))))]) + 1)


def scan(q: np.ndarray, y: np.ndarray, heap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Adaptive scan of candidates y for queries q (both rotated) with heap, each query's bound so far.

    (query rows, candidate rows) that no test abandoned."""
    n, width = len(y), y.shape[1]
    alive_q, alive_c = np.repeat(np.arange(len(q)), n), np.tile(np.arange(n), len(q))
    part = np.zeros(len(alive_q))
    at = 0
    while at < width:
        to = min(width, at + BLOCK)
        if at == 0:
            a, b = q[:, :to], y[:, :to]
            part = ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T).ravel()
        else:
            d = y[alive_c, at:to] - q[alive_q, at:to]
            part = part + np.einsum("ij,ij->i", d, d)
        at = to
        margin = (1 + EPSILON / np.sqrt(at)) ** 2 if at < width else 1 + 1e-9
        keep = part * (width / at) <= heap[alive_q] * margin + 1e-12
        alive_q, alive_c, part = alive_q[keep], alive_c[keep], part[keep]
    return alive_q, alive_c


def best_of(index: Index, q: np.ndarray, ids: np.ndarray, least: np.ndarray, x: np.ndarray, xi: np.ndarray, k: int) -> pd.DataFrame:
    """query_id, vec_id, score of the k best candidates of each query that reach its least score."""
    y, turned = index.placed(x), index.queries(q)
    out = []
    for a in range(0, len(q), TILE):
        part, own, low = q[a : a + TILE], ids[a : a + TILE], least[a : a + TILE].copy()
        new = np.flatnonzero(low == -np.inf)
        if len(new) and len(x) > k + 1:  # without a bound so far the chunk's own k-th best is one
            near = (part[new] / index.scale) @ (x / index.scale).T
            size = np.abs(near).max(axis=1)
            near[own[new][:, None] == xi[None, :]] = -np.inf
            kth = np.partition(near, len(x) - k, axis=1)[:, len(x) - k] - 1e-9 * size
            with np.errstate(over="ignore"):
                low[new] = kth * index.scale * index.scale
        bound = np.where(np.isfinite(low), index.distance(part, np.where(np.isfinite(low), low, 0.0)), np.inf)
        i, j = scan(turned[a : a + TILE], y, bound)
        other = own[i] != xi[j]
        i, j = i[other], j[other]
        with np.errstate(over="ignore", invalid="ignore"):
            score = np.einsum("ij,ij->i", part[i], x[j])
        good = score >= low[i]
        i, j, score = i[good], j[good], score[good]
        order = np.lexsort((xi[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        top = rank < k
        out.append(pd.DataFrame({"query_id": own[i[top]], "vec_id": xi[j[top]], "score": score[top]}))
    return pd.concat(out, ignore_index=True)


def searched(rows: DataFrame, index: Index, k: int) -> DataFrame:
    """query_id, vec_id, score of rows (list, chunk, id, vec, least; least is null for candidates), sorted, candidates first."""
    shared = rows.sparkSession.sparkContext.broadcast(index)  # at most LISTS centroids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, held, x, xi = None, [], None, None
        for batch in batches:
            for now, group in batch.groupby(["list", "chunk"], sort=False):
                if now != place:
                    place, x = now, None
                    held.clear()
                asks = group["least"].notna().to_numpy()
                if not asks.all():
                    held.append(group[~asks])
                if asks.any() and held:
                    if x is None:
                        every = pd.concat(held, ignore_index=True)
                        x, xi = matrix(every["vec"]), every["id"].to_numpy()
                    part = group[asks]
                    yield best_of(shared.value, matrix(part["vec"]), part["id"].to_numpy(), part["least"].to_numpy(), x, xi, k)

    return rows.mapInPandas(released(run), "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, queries: DataFrame, index: Index, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score of usable vectors and queries (id, vec)."""
    spark = vectors.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(index)

    def placed_in(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), 2048):
                part = batch.iloc[a : a + 2048]
                own = shared.value.nearest(shared.value.placed(matrix(part["vec"])), 1)[:, 0]
                yield pd.DataFrame({"list": own.astype(np.int32), "id": part["id"].to_numpy(), "vec": part["vec"].to_numpy()})

    def asking(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), 1024):
                part = batch.iloc[a : a + 1024]
                own = shared.value.nearest(shared.value.queries(matrix(part["vec"])), shared.value.probes)
                yield pd.DataFrame({"id": part["id"].to_numpy(), "vec": part["vec"].to_numpy(), "probes": list(own.astype(np.int32))})

    placed = cut(vectors.mapInPandas(released(placed_in), "list int, id long, vec array<double>"), "vector-lists")
    asked = cut(queries.mapInPandas(released(asking), "id long, vec array<double>, probes array<int>"), "vector-queries")
    sizes = placed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).select("list", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    sizes = F.broadcast(cut(sizes, "vector-sizes"))  # at most LISTS rows
    chunked = placed.join(sizes, "list").select("list", F.pmod(F.xxhash64("id", "vec"), F.col("chunks")).cast("int").alias("chunk"), "id", "vec", F.lit(None).cast("double").alias("least"))
    edges = [0, *[r for r in ROUNDS if r < index.probes], index.probes]
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best: DataFrame | None = None
    for begin, end in zip(edges[:-1], edges[1:]):
        asks = asked.withColumn("least", F.lit(float("-inf")))
        if best is not None:
            full = best.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("bound"))
            asks = asked.join(full, "id", "left").withColumn("least", F.coalesce("bound", F.lit(float("-inf"))))
        wanted = asks.select("id", "vec", "least", F.explode(F.slice("probes", begin + 1, end - begin)).alias("list"))
        wanted = wanted.join(sizes, "list").select("list", F.explode(F.expr("sequence(0, chunks - 1)")).alias("chunk"), "id", "vec", "least")
        rows = chunked.unionByName(wanted).repartition(parallelism(spark), "list", "chunk").sortWithinPartitions("list", "chunk", F.col("least").isNotNull(), "id")
        found = searched(rows, index, k)
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        best = cut(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "vector-found")
    return best.select("query_id", "rank", "vec_id", "score")


def op2_vector_search(spark, sf_dir: str) -> DataFrame:
    good = usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    index, width = fit(good)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    good = good.where(F.size("vec") == width)
    return nearest(good, good.where("id % 20 = 0").groupBy("id").agg(F.min("vec").alias("vec")), index)
