"""Column expressions. Missing is null throughout, never NaN."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def floored(x: str | Column, eps: float = EPS) -> Column:
    """max(x, eps); null stays null, which greatest alone would not keep."""
    return F.when(col(x).isNotNull(), F.greatest(col(x), F.lit(eps)))


def safe_log(x: str | Column, eps: float = EPS) -> Column:
    return F.ln(floored(x, eps))


def finite(x: str | Column) -> Column:
    return col(x).isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def pooled(a: str | Column, b: str | Column, rule: str = "max") -> Column:
    """max, mean or sum of two columns; null if either is."""
    a, b = col(a), col(b)
    rules = {"max": F.greatest(a, b), "mean": (a + b) / 2, "sum": a + b}
    if rule not in rules:
        raise ValueError(f"unknown pooling rule {rule!r}")
    return F.when(a.isNotNull() & b.isNotNull(), rules[rule])


def clamp(x: str | Column, low: Column, high: Column) -> Column:
    """x within the bounds; a null bound does not bind, a null x stays null."""
    return F.when(col(x).isNotNull(), F.least(F.greatest(col(x), low), high))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b, F.lit(0.0))


def squared_error(y: str | Column, f: str | Column) -> Column:
    return F.pow(floored(y) - floored(f), F.lit(2.0))


def qlike(y: str | Column, f: str | Column) -> Column:
    r = floored(y) / floored(f)
    return r - F.ln(r) - 1


def clark_west(y: str | Column, small: str | Column, large: str | Column) -> Column:
    """The squared-error difference of nested forecasts, adjusted for the larger one's noise."""
    y, a, b = col(y), col(small), col(large)
    return (y - a) * (y - a) - ((y - b) * (y - b) - (a - b) * (a - b))


def minutes_to_schedule(ts: str | Column, at_minutes: tuple[int, ...] = (0, 480, 960)) -> Column:
    """Minutes to the nearest of the daily times, across midnight."""
    m = F.hour(ts) * 60 + F.minute(ts)
    gaps = [F.abs(m - F.lit(x)) for x in at_minutes]
    return reduce(F.least, [F.least(g, 1440 - g) for g in gaps])


def underprediction(y: str | Column, f: str | Column) -> Column:
    return F.greatest(col(y) / floored(f) - 1, F.lit(0.0))


def horizon_label(bars: str | Column, labels: dict[int, str]) -> Column:
    named = F.coalesce(*[F.when(col(bars) == k, F.lit(v)) for k, v in labels.items()], F.lit(None).cast("string"))
    return F.coalesce(named, F.concat(col(bars).cast("string"), F.lit(" bars")))


def minus_log10(p: str | Column) -> Column:
    return -F.log10(floored(p))


def regime_weight(z: str | Column, w_max: float, k: float, gamma: float) -> Column:
    return w_max / (1 + F.exp(-k * (col(z) - gamma)))


def energy(p: str | Column, z: str | Column, r: str | Column, s: str | Column, weight: float = 1.0) -> Column:
    """1 + weight p^2 + z^2 + r^2 + s^2."""
    p, z, r, s = map(col, (p, z, r, s))
    return 1 + weight * p * p + z * z + r * r + s * s
