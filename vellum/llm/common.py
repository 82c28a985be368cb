"""Shared building blocks: scratch tables, hot-key joins and distributed ranks.

Everything here is plain DataFrame code. The three ideas every operator leans on:

* ``cut``: write an intermediate to the cluster's shared checkpoint folder and read it back, so that
  a lost executor costs one task's rerun and wide columns are not computed twice.
* ``attach``: join rows to per-group facts when one group may hold a third of all rows. Groups above
  a thousandth of the rows are at most a thousand, so they are broadcast; the others are shuffled
  and no partition can then be dominated by one key.
* ``ranked``: row numbers and running sums inside a group without sending the group to one task.
* ``located`` and ``without``: a row is named by its place in its Parquet file, so a decision about it comes back as one
  bit. The bits are broadcast behind a check of their number; beyond that rows meet them by a shuffled join.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Groups holding more than this share of all rows are broadcast, so at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.001
#: Rows that one bucket of a distributed rank aims at.
RANK_BUCKET_ROWS = 4000
#: Most words of a bitmap (64 rows or slots each) that are broadcast, about 40 bytes each.
MAX_WORDS = 1 << 20
#: Bytes of an Arrow batch that Python workers get; one longer text is a batch of its own.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only where none is set (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/scratch/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: lineage ends here."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by bytes, so that a worker's memory does not depend on the length of texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(name).rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run for mapInPandas or an iterator UDF, after which the worker gives freed memory back: it stays alive for later tasks, of other operators too."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with groups (one row per key, never null) on key, safe for hot keys.

    size names the column of groups that counts a group's rows, total is the sum over all groups.
    At most 1 / HOT_SHARE groups reach the threshold, which bounds the broadcast side.
    """
    least = max(2, int(total * HOT_SHARE))
    hot = groups.where(F.col(size) >= least)
    cold = groups.where(F.col(size) < least)
    hot_rows = rows.join(F.broadcast(hot), key, "inner")
    cold_rows = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how)
    return hot_rows.unionByName(cold_rows)


def ranked(df: DataFrame, group: list[str], order: Column, total: int, add: Column | None = None, unique: list[str] = ()) -> DataFrame:
    """Adds rank (from 0) of each row in its group by (order, unique columns), and before: the sum of add over the rows ahead.

    order is a lower-case hexadecimal string column that spreads rows evenly (a digest), so its leading digits
    split a group into ordered buckets of about RANK_BUCKET_ROWS rows: totals per bucket are summed first
    (partial aggregation), and only a bucket, never a group, is sorted in one task.
    """
    digits = 1
    while total / 16**digits > RANK_BUCKET_ROWS and digits < 7:
        digits += 1
    value = F.lit(1).cast("long") if add is None else add.cast("long")
    base = df.withColumns({"_order": order, "_value": value}).withColumn("_bucket", F.substring("_order", 1, digits))
    sums = base.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"), F.sum("_value").alias("_s"))
    ahead = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *[F.col(g).alias(f"_g_{g}") for g in group],
        F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("_s").over(ahead), F.lit(0)).alias("_s0"),
    )
    inside = Window.partitionBy(*group, "_bucket").orderBy("_order", *unique)
    local = base.withColumns({
        "_r": F.row_number().over(inside) - 1,
        "_c": F.coalesce(F.sum("_value").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    })
    on = F.col("_bucket") == F.col("_b")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return (
        local.join(offsets, on)
        .withColumns({"rank": F.col("_r") + F.col("_n0"), "before": F.col("_c") + F.col("_s0")})
        .drop("_order", "_value", "_bucket", "_r", "_c", "_b", "_n0", "_s0", *[f"_g_{g}" for g in group])
    )


def packed(docs: DataFrame, name: str = "_doc") -> DataFrame:
    """docs as one struct column, so that no column of theirs can clash with an operator's own; unpack with select("_doc.*")."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(name))


def located(docs: DataFrame) -> DataFrame:
    """_doc (the columns of docs), _file and _at: a row's Parquet file and its place in it, the same at every read.

    Anything but a plain Parquet table is first written to the shared folder.
    """
    place = [F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at")]
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "SubqueryAlias"):
        plan = plan.children().head()
    if plan.nodeName() == "LogicalRelation" and "_metadata" not in [c.lower() for c in docs.columns]:
        try:
            return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), *place)
        except AnalysisException:  # a file format without row numbers
            pass
    return cut(packed(docs), "located").select("_doc", *place)


def marked(rows: DataFrame, places: DataFrame) -> DataFrame:
    """rows (with _file and _at) and _marked: whether places (_file, _at) has the row."""
    word, bit = F.expr("shiftright(_at, 6)"), F.expr("shiftleft(1L, CAST(_at & 63 AS INT))")
    words = cut(places.select("_file", word.alias("_word"), bit.alias("_bit")).groupBy("_file", "_word").agg(F.bit_or("_bit").alias("_bits")), "marks")
    side = F.broadcast(words) if words.count() <= MAX_WORDS else words
    met = rows.withColumn("_word", word).join(side, ["_file", "_word"], "left")
    return met.withColumn("_marked", F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))).drop("_word", "_bits")


def without(rows: DataFrame, places: DataFrame) -> DataFrame:
    """The documents of located rows that are not in places, with their columns."""
    return marked(rows, places).where("NOT _marked").select("_doc.*")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
