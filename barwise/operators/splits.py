"""Named time ranges, gates, and thinning to origins that do not overlap."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwise.functions.scalars import clamp, finite
from barwise.operators.quantiles import quantiles

#: (name, first moment, last moment), both within.
DAY_SPLITS = (("train", "1995-01-01 00:00:00", "1998-12-31 23:59:59"), ("validation", "1999-01-01 00:00:00", "1999-12-31 23:59:59"), ("test", "2000-01-01 00:00:00", "2000-12-31 23:59:59"), ("recent", "2001-01-01 00:00:00", "2099-12-31 23:59:59"))
#: The published ranges of five-minute bars.
BAR_SPLITS = (("presample", "2020-01-01 00:00:00", "2020-12-31 23:59:59"), ("train", "2021-01-01 00:00:00", "2023-12-31 23:59:59"), ("validation", "2024-01-01 00:00:00", "2024-12-31 23:59:59"), ("test", "2025-01-01 00:00:00", "2025-12-31 23:59:59"), ("recent", "2026-01-01 00:00:00", "2026-12-31 23:59:59"))
HOUR_SPLITS = (("train", "2024-01-01 00:00:00", "2024-01-15 23:59:59"), ("validation", "2024-01-16 00:00:00", "2024-01-20 23:59:59"), ("test", "2024-01-21 00:00:00", "2024-01-27 23:59:59"), ("recent", "2024-01-28 00:00:00", "2024-01-30 23:59:59"))


def with_split(df: DataFrame, splits=DAY_SPLITS, name: str = "split") -> DataFrame:
    """Adds the name of the range that holds ts; null outside of all."""
    time = lambda x: F.lit(x).cast("timestamp_ntz")
    return df.withColumn(name, F.coalesce(*[F.when(F.col("ts").between(time(a), time(b)), F.lit(k)) for k, a, b in splits]))


def in_split(df: DataFrame, wanted: str | tuple[str, ...], splits=DAY_SPLITS) -> DataFrame:
    wanted = (wanted,) if isinstance(wanted, str) else wanted
    if unknown := set(wanted) - {k for k, _, _ in splits}:
        raise KeyError(f"unknown split: {', '.join(sorted(unknown))}")
    return with_split(df, splits, "_split").where(F.col("_split").isin(*wanted)).drop("_split")


def complete(df: DataFrame, columns: list[str], positive: list[str] = ()) -> DataFrame:
    """Rows whose columns are all finite and whose `positive` ones are above 0."""
    return df.where(reduce(lambda a, b: a & b, [*[finite(c) for c in columns], *[F.col(c) > 0 for c in positive]]))


def nonoverlapping(df: DataFrame, step: int | str, by=("asset",), order=("ts",)) -> DataFrame:
    """Every step-th row from the first, counted over the rows that are there; `step` is a number or a column."""
    step = F.col(step) if isinstance(step, str) else F.lit(step)
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where((F.col("_n") - 1) % step == 0).drop("_n")


def gated(df: DataFrame, by: list[str], least: int) -> DataFrame:
    """Groups of fewer than `least` rows give no rows."""
    return df.withColumn("_n", F.count("*").over(Window.partitionBy(*by))).where(F.col("_n") >= least).drop("_n")


def clip_bounds(train: DataFrame, column: str, low: float, high: float, by=("asset",)) -> DataFrame:
    """Exact interpolated quantiles of the training rows, one row a group."""
    return quantiles(train, {"clip_low": (column, low), "clip_high": (column, high)}, by)


def winsorized(df: DataFrame, bounds: DataFrame, column: str, by=("asset",)) -> DataFrame:
    """`column` clamped to its group's bounds; a group without bounds stays as it is."""
    return df.join(bounds, list(by), "left").withColumn(column, clamp(column, F.col("clip_low"), F.col("clip_high"))).drop("clip_low", "clip_high")
