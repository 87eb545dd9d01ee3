"""Sketches of streams: counters per event-time window with a watermark, updates deduplicated by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwise.functions.hashing import spread
from cellwise.operators.count_min import Sizing


def windowed_counters(stream: DataFrame, key: Column, ts: str, sizing: Sizing, window: str = "1 hour", lateness: str = "6 hours", increment: Column | None = None, update_id: str | None = None) -> DataFrame:
    """(window_start, row, col, cnt): the Count-Min counters of every window. Works on streams and on tables.

    Rows later than ``lateness`` are dropped by a stream; with ``update_id`` an update counts once within that time. Null keys are no keys.
    """
    n = F.lit(1) if increment is None else F.coalesce(increment, F.lit(0))
    ids = [F.col(update_id)] if update_id else []
    rows = stream.select(key.alias("key"), n.cast("bigint").alias("n"), F.col(ts).cast("timestamp").alias("_ts"), *[c.alias("_id") for c in ids]).where("key IS NOT NULL")
    rows = rows.withWatermark("_ts", lateness)
    if update_id:
        rows = rows.dropDuplicatesWithinWatermark(["_id"]) if stream.isStreaming else rows.dropDuplicates(["_id"])
    placed = spread(rows, "key", sizing.depth, sizing.width)
    out = placed.groupBy(F.window("_ts", window), "row", "col").agg(F.sum("n").alias("cnt"))
    return out.select(F.col("window.start").alias("window_start"), "row", "col", "cnt")


def to_memory(df: DataFrame, name: str, mode: str = "complete"):
    """Runs a stream over what is there into the in-memory table ``name``."""
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)
