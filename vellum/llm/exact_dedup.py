"""Exact de-duplication by two Bloom passes (native).

Pass one counts how many rows hit each slot of a Bloom-style table (each task sends a slot once, with its
count) and keeps the slots hit more than once as 64-bit words of a bitmap. Pass two probes it: a row one of whose
slots was not hit twice is unique for certain and goes straight through; only the rest are shuffled by their
digest, as (digest, length, id, place) and never with their text. A filter of up to MAX_WORDS words is broadcast. A
larger one stays in partitions by word: rows meet it by their first slot, those that pass by their second, and the
words that many rows hit are broadcast all the same. What goes is marked by a row's place in its file, so texts are
not shuffled either, unless there are more than MAX_WORDS words of such marks.

Defined results: a null text counts as empty; texts that are equal after white space is removed form a
group, empty ones included; of rows that tie on length the smallest doc_id stays, a null doc_id counts
as the largest, and of rows repeated with the same doc_id exactly one stays; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import MAX_WORDS, attach, cut, located, table, without

#: Slots of the repeat filter for each row.
SLOTS_PER_ROW = 16
#: Hash functions of the filter.
PROBES = 2
#: Characters that do not count when texts are compared: blank, tab, line feed, vertical tab, form feed, carriage return.
WHITE = " \t\n\x0b\x0c\r"


def narrow(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, file, at, length, digest) of every located row: all that de-duplication needs of a document."""
    text = F.coalesce(F.col(f"_doc.`{text_col}`").cast("string"), F.lit(""))
    return rows.select(
        F.col(f"_doc.`{id_col}`").cast("long").alias("id"), F.col("_file").alias("file"), F.col("_at").alias("at"),
        F.length(text).cast("long").alias("length"),
        F.unhex(F.sha2(F.translate(text, WHITE, ""), 256)).alias("digest"),
    )


def repeat_filter(rows: DataFrame, slots: int) -> DataFrame:
    """word, bits, hits: the slots that more than one row hits, as words of 64, and how often they are hit."""
    hit = (
        rows.select(F.explode(F.array_distinct(F.array(*[slot(i, slots) for i in range(PROBES)]))).alias("slot"))
        .groupBy("slot")
        .agg(F.count(F.lit(1)).alias("hits"))
        .where("hits > 1")
    )
    return hit.groupBy(F.expr("shiftright(slot, 6)").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")).alias("bits"), F.sum("hits").alias("hits")
    )


def slot(i: int, slots: int) -> Column:
    return F.pmod(F.xxhash64("digest", F.lit(i)), F.lit(slots))


def possibly_repeated(rows: DataFrame, n_rows: int) -> tuple[DataFrame, DataFrame]:
    """(rows that may be repeated, rows that are unique for certain), by the two Bloom passes."""
    slots = 1 << 10
    while slots < n_rows * SLOTS_PER_ROW:
        slots *= 2
    words = cut(repeat_filter(rows, slots), "dedup-filter")
    few = words.count() <= MAX_WORDS
    columns, maybe, single = rows.columns, rows, []
    for i in range(PROBES):
        probing = maybe.withColumn("slot", slot(i, slots)).withColumn("word", F.expr("shiftright(slot, 6)"))
        met = probing.join(F.broadcast(words), "word", "left") if few else attach(probing, words, "word", "hits", PROBES * n_rows, "left")
        passed = F.coalesce(F.expr("bits & shiftleft(1L, CAST(slot & 63 AS INT))") != 0, F.lit(False))
        met = cut(met.select(*columns, passed.alias("passed")), f"dedup-probe-{i}")
        single.append(met.where("NOT passed").select(*columns))
        maybe = met.where("passed").select(*columns)
    unique = single[0]
    for more in single[1:]:
        unique = unique.unionByName(more)
    return maybe, unique


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, file, at, digest, keep (id, file, at) and group_size."""
    return groups_of(located(docs), id_col, text_col)


def groups_of(placed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = cut(narrow(placed, id_col, text_col), "dedup-digests")
    n = rows.count()
    maybe, single = possibly_repeated(rows, n)
    groups = maybe.groupBy("digest").agg(
        F.min_by(F.struct("id", "file", "at"), F.struct(-F.col("length"), F.col("id").isNull(), "id", "file", "at")).alias("keep"),
        F.count(F.lit(1)).alias("group_size"),
    )
    shown = ["id", "file", "at", "digest", "keep", "group_size"]
    found = attach(maybe, cut(groups, "dedup-groups"), "digest", "group_size", n).select(*shown)
    return found.unionByName(single.withColumns({"keep": F.struct("id", "file", "at"), "group_size": F.lit(1).cast("long")}).select(*shown))


def stays() -> Column:
    return (F.col("file") == F.col("keep.file")) & (F.col("at") == F.col("keep.at"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns."""
    placed = located(docs)
    gone = groups_of(placed, id_col, text_col).where(~stays())
    return without(placed, gone.select(F.col("file").alias("_file"), F.col("at").alias("_at")))


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    g = exact_groups(table(spark, sf_dir, "documents"))
    return g.select(
        F.col("id").alias("doc_id"), F.col("keep.id").alias("keep_id"), "group_size", stays().alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


OP5_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
k AS (
  SELECT text_sha256, count(*) AS group_size,
         arg_min(doc_id, (-n, doc_id)) AS keep_id
  FROM t GROUP BY 1)
SELECT t.doc_id, k.keep_id, k.group_size, t.doc_id = k.keep_id AS kept, t.text_sha256
FROM t JOIN k USING (text_sha256)
"""
