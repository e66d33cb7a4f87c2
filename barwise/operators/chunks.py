"""Frames over series of any length: numbering, windows and carried values without one task per series."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(bars: DataFrame, span: str = "month", by=("asset",)) -> DataFrame:
    """Adds rn, the row number from 0 in each series. Rows are sorted by calendar span; only counts are summed up by series."""
    spans = bars.withColumn("_span", F.date_trunc(span, "ts"))
    before = Window.partitionBy(*by).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    starts = spans.groupBy(*by, "_span").count().select(*by, "_span", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*by, "_span").orderBy("ts")
    ranked = spans.withColumn("_rank", F.row_number().over(within) - 1)
    keys = [ranked[c].eqNullSafe(starts[c]) for c in (*by, "_span")]
    joined = ranked.join(starts, keys, "left").select(*[ranked[c] for c in ranked.columns], "_start")
    return joined.withColumn("rn", (F.col("_start") + F.col("_rank")).cast("long")).drop("_span", "_rank", "_start")


def in_chunks(bars: DataFrame, transform: Callable[[DataFrame, tuple[str, ...]], DataFrame], back: int, ahead: int = 0, rows: int = 100_000, by=("asset",)) -> DataFrame:
    """transform(bars, keys) where every row sees at least `back` rows before and `ahead` after it.

    Series are cut into chunks of `rows`; rows near a cut are given to the neighbours as well, and each
    chunk returns only its own. A series then is as many tasks as it has chunks.
    """
    if max(back, ahead) > rows:
        raise ValueError("a chunk must be longer than the frames")
    own = F.floor(F.col("rn") / rows)
    homes = F.sequence(F.greatest(F.floor((F.col("rn") - ahead) / rows), F.lit(0)), F.floor((F.col("rn") + back) / rows))
    spread = numbered(bars, by=by).withColumn("_own", own).withColumn("_chunk", F.explode(homes))
    return transform(spread, (*by, "_chunk")).where("_own = _chunk").drop("_own", "_chunk", "rn")


def with_last(df: DataFrame, columns: dict[str, str], span: str = "month", by=("asset",)) -> DataFrame:
    """Adds, by new name, the last non-null value so far of each column.

    Rows are sorted by calendar span; what a span inherits comes from a table of one row a span.
    """
    by = list(by)
    rows = df.withColumn("_span", F.date_trunc(span, "ts"))
    ends = rows.groupBy(*by, "_span").agg(*[F.max_by(x, F.when(F.col(x).isNotNull(), F.col("ts"))).alias(f"_end_{name}") for name, x in columns.items()])
    before = Window.partitionBy(*by).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    held = ends.select(*[F.col(c).alias(f"_of_{c}") for c in (*by, "_span")], *[F.last(f"_end_{name}", ignorenulls=True).over(before).alias(f"_held_{name}") for name in columns])
    joined = rows.join(held, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*by, "_span")], "left")
    so_far = Window.partitionBy(*by, "_span").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return joined.select(*df.columns, *[F.coalesce(F.last(x, ignorenulls=True).over(so_far), f"_held_{name}").alias(name) for name, x in columns.items()])
