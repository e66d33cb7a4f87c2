"""Bars of a stream of ticks, by event-time windows under a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stream_bars(ticks: DataFrame, asset: Column, price: Column, width: str, late: str, order: tuple[str, ...], time: str = "ts") -> DataFrame:
    """(asset, ts, open, high, low, close, volume) of windows of `width`, updated as ticks arrive.

    Of a stream, run in update mode: a bar comes again whenever a tick changes it. Ticks later than `late` behind the
    newest one are dropped, and bars that old leave the state, so the state holds the open bars only. Open and close are
    the first and last by `order`, whatever order the ticks arrive in; volume counts ticks.
    """
    timed = ticks.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", late)
    place = F.struct(*order)
    rows = timed.select("_time", asset.alias("asset"), price.alias("_price"), place.alias("_place"))
    bars = rows.groupBy("asset", F.window("_time", width).alias("_window")).agg(
        F.min_by("_price", "_place").alias("open"), F.max("_price").alias("high"), F.min("_price").alias("low"), F.max_by("_price", "_place").alias("close"), F.count("*").cast("double").alias("volume")
    )
    return bars.select("asset", F.col("_window.start").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume")


def latest(updates: DataFrame, keys: tuple[str, ...] = ("asset", "ts"), version: str = "batch") -> DataFrame:
    """The newest version of each key among the rows that update mode has written, batch by batch."""
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(version)))
    return updates.withColumn("_newest", newest).where("_newest = 1").drop("_newest", version)
