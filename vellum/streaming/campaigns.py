"""Campaigns over a stream of messages: an extension; the batch operators are correlate.shared and correlate.triage.

Indicators that appear in several messages inside an event-time window, with late data bounded by a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_campaigns(indicators: DataFrame, window: str = "1 hour", late: str = "10 minutes", key: str = "message_id", at: str = "at") -> DataFrame:
    """window, type, value, n of indicators (key, type, value, at) in more than one message of a window.

    Repeats of an indicator within a message go first, inside the watermark, so that n counts messages; both steps
    keep state for open windows only.
    """
    slot = F.window(at, window)
    once = indicators.withWatermark(at, late).withColumn("slot", slot).dropDuplicates([key, "type", "value", "slot"])
    return once.groupBy("slot", "type", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("slot.start").alias("window_start"), "type", "value", "n")


def write(stream: DataFrame, path: str, checkpoint: str, once: bool = False):
    """A Parquet sink in append mode; once: what is there now, then stop."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
