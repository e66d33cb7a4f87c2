"""Windows over the rows of a series in time order. A value needs a full frame of non-null rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barwise.functions.scalars import col, ratio

BY, ORDER = ("asset",), ("ts",)


def series(by=BY, order=ORDER) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def framed(aggregate, x: str | Column, low: int, high: int, by=BY, order=ORDER, least: int | None = None) -> Column:
    """aggregate(x) over rows low..high around the current one, if `least` of them (all, if not given) are not null."""
    frame = series(by, order).rowsBetween(low, high)
    return F.when(F.count(x).over(frame) >= (high - low + 1 if least is None else least), aggregate(x).over(frame))


def rolling_sum(x: str | Column, n: int, by=BY, order=ORDER) -> Column:
    return framed(F.sum, x, 1 - n, 0, by, order)


def _two_sided(df: DataFrame, values: dict[str, tuple[Column, str]], n: int, by, order) -> DataFrame:
    """Adds, for each name, _begun_<name> and _left_<name>: its sum, max, min or count from the row's block's start, and to its end.

    Rows stand in blocks of n, so a frame of n rows is the end of one block and the beginning of the next.
    """
    pick = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}
    placed = df.withColumn("_block", F.floor((F.row_number().over(series(by, order)) - 1) / n))
    block = Window.partitionBy(*by, "_block")
    begun, left = (block.orderBy(*[f(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0) for f in (F.asc, F.desc))
    return placed.withColumns({f"_{side}_{name}": pick[kind](x).over(frame) for name, (x, kind) in values.items() for side, frame in (("begun", begun), ("left", left))})


def with_extremes(df: DataFrame, wanted: dict[str, tuple[str, str]], n: int, by=BY, order=ORDER) -> DataFrame:
    """Adds, by new name, the "max" or "min" of a column over the last n rows, of those not null; cost does not grow with n.

    Each is the greater (or lesser) of a running extreme back from one block's end and one on from the next one's start.
    """
    both = _two_sided(df, {name: (col(x), kind) for name, (x, kind) in wanted.items()}, n, by, order)
    w = series(by, order)
    # least and greatest leave nulls out; in the first block there is nothing before the frame
    made = {name: {"max": F.greatest, "min": F.least}[kind](f"_begun_{name}", F.lag(f"_left_{name}", n - 1).over(w)) if n > 1 else col(x) for name, (x, kind) in wanted.items()}
    return both.select(*df.columns, *[c.alias(name) for name, c in made.items()])


def with_long_sums(df: DataFrame, sums: dict[str, tuple[str, int]], by=BY, order=ORDER) -> DataFrame:
    """rolling_sum for long frames at a cost that does not grow with them.

    A frame's sum is that of the end of one block and of the beginning of the next. Nothing is taken off a running total, so
    no digits are lost, however small a frame's sum is beside the series'.
    """
    out, w = df, series(by, order)
    for n in dict.fromkeys(n for _, n in sums.values()):
        here = {name: x for name, (x, m) in sums.items() if m == n}
        both = _two_sided(out, {k: v for name, x in here.items() for k, v in ((f"s_{name}", (F.coalesce(col(x), F.lit(0.0)), "sum")), (f"n_{name}", (col(x), "count")))}, n, by, order)
        # the last row of a block has its whole frame in the block
        ends = F.col("_block") == F.lag("_block", n - 1).over(w) if n > 1 else F.lit(True)
        part = lambda c: F.when(ends, F.col(f"_begun_{c}")).otherwise(F.col(f"_begun_{c}") + F.lag(f"_left_{c}", n - 1).over(w))  # noqa: B023, E731
        out = both.select(*out.columns, *[F.when(part(f"n_{name}") == n, part(f"s_{name}")).alias(name) for name in here])
    return out


def with_shifted_z(df: DataFrame, wanted: dict[str, str], n: int, by=BY, order=ORDER) -> DataFrame:
    """shifted_z of columns, by new name, at a cost that does not grow with n.

    Moments are sums of the ends and beginnings of blocks of n rows, about the mean of all rows at hand; whether a frame
    varies at all is told by its extremes, so that a constant one gives null whatever the rounding.
    """
    centred = df.withColumns({f"_c_{name}": col(x) - F.avg(x).over(Window.partitionBy(*by)) for name, x in wanted.items()})
    values = {}
    for name in wanted:
        c = F.col(f"_c_{name}")
        values |= {f"s_{name}": (F.coalesce(c, F.lit(0.0)), "sum"), f"q_{name}": (F.coalesce(c * c, F.lit(0.0)), "sum"), f"n_{name}": (c, "count"), f"h_{name}": (c, "max"), f"l_{name}": (c, "min")}
    both, w = _two_sided(centred, values, n, by, order), series(by, order)
    ends = F.col("_block") == F.lag("_block", n - 1).over(w) if n > 1 else F.lit(True)
    before = lambda c: F.lag(f"_left_{c}", n - 1).over(w)
    total = lambda c: F.when(ends, F.col(f"_begun_{c}")).otherwise(F.col(f"_begun_{c}") + before(c))
    frames = {}
    for name in wanted:
        mean = total(f"s_{name}") / n
        flat = F.greatest(f"_begun_h_{name}", before(f"h_{name}")) == F.least(f"_begun_l_{name}", before(f"l_{name}"))
        sd = F.when(flat, 0.0).otherwise(F.sqrt(F.greatest(total(f"q_{name}") / n - mean * mean, F.lit(0.0))))
        full = total(f"n_{name}") == n
        frames |= {f"_mean_{name}": F.when(full, mean), f"_sd_{name}": F.when(full, sd)}
    framed_rows = both.withColumns(frames)
    z = {name: ratio(F.col(f"_c_{name}") - F.lag(f"_mean_{name}").over(w), F.lag(f"_sd_{name}").over(w)) for name in wanted}
    return framed_rows.select(*df.columns, *[c.alias(name) for name, c in z.items()])


def shifted_z(x: str | Column, n: int, by=BY, order=ORDER, least: int | None = None) -> Column:
    """x against mean and population deviation of the n rows before it; null where they do not vary."""
    mean, sd = (framed(f, x, -n, -1, by, order, least) for f in (F.avg, F.stddev_pop))
    return ratio(col(x) - mean, sd)


def current_z(x: str | Column, n: int, by=BY, order=ORDER, floor: float = 1e-12) -> Column:
    """x against the n rows that end with it, for display only: it is not adapted to the past."""
    mean, sd = (framed(f, x, 1 - n, 0, by, order) for f in (F.avg, F.stddev_pop))
    return (col(x) - mean) / F.when(sd.isNotNull(), F.greatest(sd, F.lit(floor)))
