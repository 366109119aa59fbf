"""Streams of ticks: closed bars, emitted once, and events already sent left out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.lake import append_guarded


def closed_bars(ticks: DataFrame, rule: str, lateness: str) -> DataFrame:
    """Bars of a stream (symbol, ts, seq, price, volume): each is emitted when the watermark passes its end.

    A tick sent twice within the watermark counts once; later ticks than that are dropped, and a batch run over the
    stored ticks repairs the bar.
    """
    at = F.struct("ts", "seq")
    held = ticks.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["symbol", "seq"])
    out = held.groupBy("symbol", F.window("ts", rule).alias("w")).agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume"))
    return out.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def append_new(events: DataFrame, path: str, id_col: str = "event_id") -> None:
    """Append the rows whose id the table at ``path`` doesn't have yet in their month, partitioned by month."""
    once = events.dropDuplicates([id_col]).withColumn("month", F.date_format("ts", "yyyy-MM"))
    append_guarded(once, path, [id_col], ["month"], known="skip")
