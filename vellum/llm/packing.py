"""Best-fit packing by a linear grouping scheme.

Lengths are integers up to the capacity, so the corpus enters the plan as a histogram of at most
``capacity`` counts, whatever its size. The planner works on that histogram in the driver:

1. large lengths (over a share of the capacity) are sorted and cut into GROUPS groups of equal
   cardinality, each rounded up to its largest length;
2. the few rounded sizes are packed by configurations: a column-generation linear program whose
   columns come from an integer knapsack over the capacity, rounded down to whole configurations;
3. actual lengths are put in the place of rounded ones, in order;
4. what is left - large remainders and all small lengths - goes best fit, longest first, into the
   free room of the runs of equal sequences.

The shares in LARGE are tried in turn, until a plan needs no more sequences than the tokens alone
ask for; the plan with the fewest is kept. The plan is a table of slots: for a length, a range of ranks and the sequences and offsets they go
to. Its size depends on the capacity only, so it is broadcast; each piece finds its slot by its rank
among the pieces of its length, which is computed without one task per length.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import cut, ranked, released, small_batches, table

CAPACITY = 2048
#: Lengths over this share of the capacity are packed by configurations; tried in this order.
LARGE = (1 / 2, 1 / 3, 1 / 4, 1 / 8)
#: Number of equal-cardinality groups of large lengths.
GROUPS = 48
#: Words each worker remembers at most between blocks; the frequent ones come early, so none is dropped for a later one.
MEMO = 200_000


# --- the plan, from a histogram -------------------------------------------------------------------


def knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best multiset of sizes within capacity: its value and how many of each size."""
    best = np.zeros(capacity + 1)
    take = np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        best[room], take[room] = best[room - 1], -1
        fit = np.flatnonzero(sizes <= room)
        if len(fit):
            gain = best[room - sizes[fit]] + values[fit]
            k = int(gain.argmax())
            if gain[k] > best[room] + 1e-12:
                best[room], take[room] = gain[k], fit[k]
    counts, room = np.zeros(len(sizes), dtype=np.int64), capacity
    while room > 0:
        if take[room] < 0:
            room -= 1
        else:
            counts[take[room]] += 1
            room -= int(sizes[take[room]])
    return float(best[capacity]), counts


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """Whole configurations from the linear relaxation of cutting stock, rounded down."""
    k = len(sizes)
    if not k:
        return []
    columns = np.diag(capacity // sizes).astype(float)
    for _ in range(rounds):
        inverse = np.linalg.inv(columns)
        amount = inverse @ demand
        prices = np.ones(k) @ inverse
        value, counts = knapsack(sizes, prices, capacity)
        if value <= 1 + 1e-7:
            break
        direction = inverse @ counts
        rising = direction > 1e-9
        if not rising.any():
            break
        steps = np.where(rising, amount / np.where(rising, direction, 1), np.inf)
        columns[:, int(steps.argmin())] = counts
    amount = np.linalg.inv(columns) @ demand
    out, left = [], demand.astype(np.int64).copy()
    for j in range(k):
        counts = np.rint(columns[:, j]).astype(np.int64)
        times = int(min(np.floor(amount[j] + 1e-6), *(left[i] // counts[i] for i in np.flatnonzero(counts))))
        if times > 0:
            out.append((counts, times))
            left -= counts * times
    return out


class Runs:
    """Runs of equal sequences, found by their free room. Items are (length, first rank, per sequence, offset)."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.rooms, self.runs = capacity, [], {}

    def push(self, room: int, times: int, items: list) -> None:
        if times <= 0:
            return
        if room not in self.runs:
            bisect.insort(self.rooms, room)
            self.runs[room] = []
        self.runs[room].append((times, items))

    def pop(self, least: int) -> tuple[int, int, list] | None:
        """The run with the smallest room of at least this, taken out."""
        k = bisect.bisect_left(self.rooms, least)
        if k == len(self.rooms):
            return None
        room = self.rooms[k]
        times, items = self.runs[room].pop()
        if not self.runs[room]:
            del self.runs[room]
            self.rooms.pop(k)
        return room, times, items


def put(run: list, times: int, length: int, rank: int, each: int, room: int, capacity: int) -> list:
    """run's items with each pieces of the length more in every one of its sequences."""
    return [*run, (length, rank, each, capacity - room)]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[int, int, int, int, int, int]]:
    """The best of the plans for the shares in LARGE."""
    least = -(-sum(n * c for n, c in histogram.items()) // capacity)
    best, fewest = [], None
    for large in LARGE:
        slots = plan_for(histogram, capacity, large, groups)
        sequences = max((s[4] + s[2] // s[3] for s in slots), default=0)
        if fewest is None or sequences < fewest:
            best, fewest = slots, sequences
        if fewest <= least:
            break
    return best


def plan_for(histogram: dict[int, int], capacity: int, large: float, groups: int) -> list[tuple[int, int, int, int, int, int]]:
    """Slots (length, first rank, number, pieces per sequence, first sequence, offset) for a histogram of lengths."""
    left = {int(n): int(c) for n, c in histogram.items() if c > 0 and 0 < n <= capacity}
    used = dict.fromkeys(left, 0)
    runs = Runs(capacity)
    if capacity in left:
        runs.push(0, left[capacity], [(capacity, 0, 1, 0)])
        used[capacity] = left.pop(capacity)
        left[capacity] = 0
    big = [n for n in sorted(left, reverse=True) if n > capacity * large and left[n]]
    total = sum(left[n] for n in big)
    if total:
        share = -(-total // groups)
        members: list[list[tuple[int, int]]] = [[]]
        room = share
        for n in big:
            c = left[n]
            while c:
                if not room:
                    members.append([])
                    room = share
                t = min(c, room)
                members[-1].append((n, t))
                c, room = c - t, room - t
        merged: dict[int, list[tuple[int, int]]] = {}
        for m in members:  # groups that round to one size are one group
            merged.setdefault(m[0][0], []).extend(m)
        sizes = np.array(list(merged), dtype=np.int64)
        demand = np.array([sum(c for _, c in merged[n]) for n in merged], dtype=np.int64)
        stock = [list(merged[int(n)]) for n in sizes]
        for counts, times in configurations(sizes, demand, capacity):
            # every place of the configuration takes actual lengths in order; the run is cut where a length ends
            places = [g for g in np.flatnonzero(counts) for _ in range(counts[g])]
            rows = []
            for g in places:
                need, got = times, []
                while need:
                    n, c = stock[g][0]
                    t = min(c, need)
                    got.append((n, t))
                    need -= t
                    stock[g][0] = (n, c - t)
                    if c == t:
                        stock[g].pop(0)
                rows.append(got)
            cuts = sorted({sum(t for _, t in got[: i + 1]) for got in rows for i in range(len(got))})
            begin = 0
            for end in cuts:
                items, room = [], capacity
                for got in rows:
                    at = 0
                    for n, t in got:
                        at += t
                        if at > begin:
                            break
                    same = end - begin
                    items.append((n, used[n], 1, capacity - room))
                    used[n] += same
                    left[n] -= same
                    room -= n
                runs.push(room, end - begin, items)
                begin = end
    for n in sorted(left, reverse=True):
        while left[n]:
            found = runs.pop(n)
            if found is None:
                each = capacity // n
                room, times, items = capacity, max(1, left[n] // each), []
            else:
                room, times, items = found
            each = min(room // n, left[n])
            full = min(times, left[n] // each)
            runs.push(room - each * n, full, put(items, full, n, used[n], each, room, capacity))
            if found is not None:
                # ranks of the items already there go on in the rest of the run
                runs.push(room, times - full, [(a, r + full * e, e, o) for a, r, e, o in items])
            used[n] += full * each
            left[n] -= full * each
    slots, sequence = [], 0
    for room in runs.rooms:
        for times, items in runs.runs[room]:
            slots += [(n, rank, times * each, each, sequence, offset) for n, rank, each, offset in items]
            sequence += times
    return slots


# --- tokens ---------------------------------------------------------------------------------------

_encoders: dict = {}


class WordMemo:
    """Byte-pair ids of whole texts as bytes of little-endian 32-bit numbers.

    The vocabulary's pattern never joins what a single blank between two other characters divides, so such a
    text is a row of units (a word with the blank before it) whose ids do not depend on one another. Units not
    seen before are encoded together, in one call, and cut apart by the byte lengths of their tokens; frequent
    ones are remembered. Texts with longer or mixed white space next to a blank are encoded as a whole. Texts that
    hold an added token of the vocabulary are divided at it first, and it gets its own id.
    """

    def __init__(self, path: str) -> None:
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            read = json.load(f)
        model = read["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in read["added_tokens"]}
        self.divide = re.compile("|".join(re.escape(t) for t in self.added) or r"(?!)")
        # the usual printable stand-ins for bytes of byte-level vocabularies: printable Latin-1 stands for itself, the others follow from 256
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        stands = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}
        ranks = {bytes(stands[c] for c in w): i for w, i in model.items() if all(c in stands for c in w)}
        ranks = {w: i for w, i in ranks.items() if w.decode("utf-8", "replace") not in self.added}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.encode = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.widths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for w, i in ranks.items():
            self.widths[i] = len(w)
        self.memo: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        ids, at = [], 0
        for m in self.divide.finditer(text):
            ids += [*self.encode(text[at : m.start()]), self.added[m[0]]]
            at = m.end()
        return np.array(ids + self.encode(text[at:]), dtype="<u4").tobytes()

    def learn(self, units: list[str]) -> dict[str, bytes]:
        """Ids of words as they stand after a blank."""
        ids = np.array(self.encode(" " + " ".join(units)), dtype="<u4")
        ends = np.cumsum(self.widths[ids])
        sizes = np.fromiter(map(len, map(str.encode, units)), dtype=np.int64, count=len(units)) + 1
        cuts = 4 * (np.searchsorted(ends, np.cumsum(sizes)) + 1)
        raw, at, out = ids.tobytes(), 0, []
        for end in cuts.tolist():
            out.append(raw[at:end])
            at = end
        return dict(zip(units, out))

    def batch(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text."""
        memo, block, size = self.memo, [], 0
        for text in [*texts, None]:
            if text is not None:
                block.append(text)
                size += len(text)
            if block and (text is None or size > 1 << 19):
                split = [t.split(" ") for t in block]
                split = [None if "" in s or " ".join(map(str.strip, s)) != t or self.divide.search(t) else s for s, t in zip(split, block)]
                first = [s.pop(0) if s else "" for s in split]
                fresh = list(set().union(*filter(None, split)).difference(memo))
                if fresh:
                    memo.update(self.learn(fresh))
                for t, head, words in zip(block, first, split):
                    yield self.whole(t) if words is None else self.whole(head) + b"".join(map(memo.__getitem__, words))
                if len(memo) > MEMO:
                    for u in fresh:
                        del memo[u]
                block, size = [], 0

    def ids(self, text: str) -> bytes:
        return next(self.batch([text]))


def encoder(path: str) -> WordMemo:
    if path not in _encoders:
        _encoders[path] = WordMemo(path)
    return _encoders[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's pieces: doc_id, piece, start, length, ids_crc32. A document's ids end with id 0.

    Only documents over the capacity are cut; the first piece takes the remainder, the others are full.
    tokenizer is the file's path on the workers; the default is found there by name.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer or default_tokenizer())
        end = (0).to_bytes(4, "little")
        for batch in batches:
            rows: list = []
            texts = [t or "" for t in batch["text"]]
            for doc, ids in zip(batch["doc_id"], encode.batch(texts)):
                ids += end
                total = len(ids) // 4
                first = total % capacity or capacity
                at, number = 0, 0
                while at < total:
                    n = first if not number else capacity
                    rows.append((doc, number, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)])))
                    at, number = at + n, number + 1
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})
        encode.memo.clear()

    small_batches(docs.sparkSession)
    wanted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return wanted.mapInPandas(released(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit_packing(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces with sequence_id and offset; sequences have no gaps and at most capacity tokens.

    Defined results: null and empty texts are one piece of length 1 (the end id); documents repeated with one
    doc_id are each packed; an empty table gives no rows.
    """
    spark = docs.sparkSession
    got = cut(pieces(docs, tokenizer, capacity, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "packing-pieces")
    histogram = {r["length"]: r["n"] for r in got.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    slots = plan(histogram, capacity)
    schema = "s_length long, first long, number long, each long, sequence long, base long"
    slot = spark.createDataFrame(slots, schema) if slots else spark.createDataFrame([], schema)
    numbered = ranked(got, ["length"], F.md5(F.concat_ws(":", "doc_id", "piece", "row")), sum(histogram.values()), unique=["row"])
    # slots of one length in one array: each piece looks its slot up by bisection-free filtering of a short, bounded array
    by_length = slot.groupBy("s_length").agg(F.array_sort(F.collect_list(F.struct("first", "number", "each", "sequence", "base"))).alias("slots"))
    placed = numbered.join(F.broadcast(by_length), F.col("length") == F.col("s_length")).withColumn(
        "slot", F.expr("element_at(filter(slots, s -> rank >= s.first AND rank < s.first + s.number), 1)")
    )
    inside = F.col("rank") - F.col("slot.first")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("slot.sequence") + F.floor(inside / F.col("slot.each"))).cast("long").alias("sequence_id"),
        (F.col("slot.base") + F.pmod(inside, F.col("slot.each")) * F.col("length")).cast("long").alias("offset"),
    )


def op8_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))
