"""Correlation across messages: shared indicators, comparison tables and triage order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import fixed
from vellum.operators.score import tier_rank


def indicators(rows: DataFrame, key: str, columns: dict[str, Column | list[Column]]) -> DataFrame:
    """key, type, value from columns by indicator type; values in lower case, nulls and empty ones left out."""
    items = F.array(*[F.struct(F.lit(t).alias("type"), F.lower(c.cast("string")).alias("value")) for t, cs in columns.items() for c in (cs if isinstance(cs, list) else [cs])])
    return rows.select(key, F.inline(items)).where("value IS NOT NULL AND value <> ''")


def shared(found: DataFrame, key: str, members: int | None = None) -> DataFrame:
    """type, value, n, weight, first_seen of values in more than one message (and the first so many members).

    Two aggregations by (type, value): the first drops repeats inside a message, which Spark combines before its shuffle,
    so that a value that a third of all messages share arrives as one row per task.
    """
    weight = F.lit(fixed.OTHER_WEIGHT)
    for name, w in fixed.INDICATOR_WEIGHTS.items():
        weight = F.when(F.col("type") == name, w).otherwise(weight)
    once = found.select(key, "type", "value").distinct()
    out = once.groupBy("type", "value").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_seen")).where("n > 1").withColumn("weight", weight.cast("long"))
    if members:
        mine = once.join(out.select("type", "value"), ["type", "value"], "left_semi")
        top = mine.withColumn("_n", F.row_number().over(Window.partitionBy("type", "value").orderBy(key))).where(F.col("_n") <= members)
        lists = top.groupBy("type", "value").agg(F.array_sort(F.collect_list(key)).alias("members"))
        out = out.join(lists, ["type", "value"])
    return out


def strongest(found: DataFrame) -> list[Column]:
    """The order of shared indicators: most messages, heaviest kind, first seen, then by name."""
    return [F.desc("n"), F.desc("weight"), "first_seen", "type", "value"]


def comparison(rows: DataFrame, key: str, fields: list[str], messages: list) -> DataFrame:
    """field, one column m<id> per compared message, identical (every message the same, two or more)."""
    cols = [F.col(f).cast("string").alias(f) for f in fields]
    tall = rows.where(F.col(key).isin(messages)).select(key, *cols).unpivot([key], fields, "field", "value")
    wide = tall.groupBy("field").pivot(key, messages).agg(F.first("value"))
    named = wide.select("field", *[F.col(f"`{m}`").alias(f"m{m}") for m in messages])
    values = F.array(*[F.col(f"m{m}") for m in messages])
    same = (F.size(F.array_distinct(values)) == 1) & F.col(f"m{messages[0]}").isNotNull() if len(messages) > 1 else F.lit(False)
    return named.withColumn("identical", same)


def triage(verdicts: DataFrame, key: str) -> DataFrame:
    """Verdicts in the order of work: tier, score, then first come."""
    return verdicts.orderBy(tier_rank(F.col("tier")), F.desc("score"), key)
