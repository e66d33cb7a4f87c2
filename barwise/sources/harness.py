"""Bars, events and paths derived from the harness tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwise.sources.bars import bars_of_ticks


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of each return flag: volume-weighted close, extreme unit prices, total quantity."""
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    return (
        _table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_returnflag").alias("asset"), F.col("l_shipdate").cast("timestamp_ntz").alias("ts"))
        .agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"), F.max(unit).alias("high"), F.min(unit).alias("low"), F.sum("l_quantity").alias("volume"))
    )


def hour_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of each event type, priced at one plus the value."""
    return bars_of_ticks(_table(spark, sf_dir, "events"), F.col("event_type"), 1 + F.col("value"), "hour", ["ts", "event_id"])


def rate_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Irregular rate events: (funding_time, event_id, last_funding_rate)."""
    return _table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("ts").cast("timestamp_ntz").alias("funding_time"), "event_id", ((F.col("value") - 50) / 1e4).alias("last_funding_rate"))


def user_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path_id, step, price, signal): each user's values in time order."""
    step = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return _table(spark, sf_dir, "events").select(F.col("user_id").alias("path_id"), step.alias("step"), ((F.col("value") - 20) / 100).alias("price"), (F.col("value") / 20).alias("signal"))
