"""As-of joins over ranges of the time line: within a range one sort of both sides carries the last (or next) event over.

Both sides are range-partitioned by key and time together, so that ranges hold about as many rows each, however dense a
stretch of time is; rows of one key and time are never parted. The last event of the ranges before, and the next one of
the ranges after, come from a table of one row a key and range, and nothing is compared pairwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwise.operators.settle import settled


def _line(left: DataFrame, right: DataFrame, left_time: str, right_time: str, payload: Column, by: list[str]) -> DataFrame:
    """Both sides' rows (by..., _t, _span, _side 0 for events, _row or _event); those without a time are left out. _span numbers the ranges."""
    rows = left.where(F.col(left_time).isNotNull()).select(*by, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_row"))
    events = right.where(F.col(right_time).isNotNull()).select(*by, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), payload.alias("_event"))
    return settled(rows.unionByName(events, allowMissingColumns=True).repartitionByRange(*by, "_t").withColumn("_span", F.spark_partition_id()))


def _carried(line: DataFrame, by: list[str], **picks: tuple[Column, bool]) -> DataFrame:
    """`line` with an event of other ranges per pick: (which event of a range, whether of the ranges before or after)."""
    spans = line.groupBy(*by, "_span").agg(*[F.max(F.when(F.col("_side") == 0, x)).alias(name) if before else F.min(F.when(F.col("_side") == 0, x)).alias(name) for name, (x, before) in picks.items()])
    order = lambda before: Window.partitionBy(*by).orderBy("_span" if before else F.desc("_span")).rowsBetween(Window.unboundedPreceding, -1)
    known = spans.select(*[F.col(c).alias(f"_of_{c}") for c in (*by, "_span")], *[F.last(name, ignorenulls=True).over(order(before)).alias(name) for name, (_, before) in picks.items()])
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*by, "_span")]
    return line.join(known, same, "left").select(*line.columns, *picks)


def asof_backward(left: DataFrame, right: DataFrame, left_time: str, right_time: str, columns: list[str], by: list[str] | None = None, ties: list[str] | None = None) -> DataFrame:
    """`left` with `columns` of the newest right row at or before its time (null: none), of equal times the last by `ties`.

    Every left row stays, those without a time too.
    """
    by = by or []
    payload = F.struct(*[F.col(c).alias(f"_{c}") for c in ties or []], *[F.col(c) for c in columns])
    line = _line(left, right, left_time, right_time, payload, by)
    held = _carried(line, by, _before=(F.struct("_t", "_event"), True))
    order = ["_t", "_side"] + ["_event"] * bool(ties)
    last = F.last("_event", ignorenulls=True).over(Window.partitionBy(*by, "_span").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    found = held.withColumn("_found", F.coalesce(last, "_before._event")).where("_side = 1")
    timed = found.select("_row.*", *[F.col(f"_found.{c}").alias(c) for c in columns])
    untimed = left.where(F.col(left_time).isNull()).select("*", *[F.lit(None).cast(timed.schema[c].dataType).alias(c) for c in columns])
    return timed.union(untimed)


def gap_to_nearest(left: DataFrame, right: DataFrame, left_time: str, right_time: str, name: str, tolerance_minutes: float, by: list[str] | None = None) -> DataFrame:
    """`left` with `name`: minutes to the nearest right row before or after, null if over the tolerance or without a time."""
    by = by or []
    line = _line(left, right, left_time, right_time, F.col(right_time), by)
    held = _carried(line, by, _earlier=(F.col("_event"), True), _later=(F.col("_event"), False))
    up_to = lambda *order: F.last("_event", ignorenulls=True).over(Window.partitionBy(*by, "_span").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    both = held.withColumns({"_before": F.coalesce(up_to("_t", "_side"), "_earlier"), "_after": F.coalesce(up_to(F.desc("_t"), F.desc("_side")), "_later")}).where("_side = 1")
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    near = F.least(*[F.abs(micros(F.col("_t")) - micros(F.col(t))) / 60e6 for t in ("_before", "_after")])
    timed = both.select("_row.*", F.when(near <= tolerance_minutes, near).alias(name))
    return timed.union(left.where(F.col(left_time).isNull()).select("*", F.lit(None).cast("double").alias(name)))
