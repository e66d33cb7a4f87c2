"""Tail probabilities of small result tables, as pandas UDFs over the few statistics in them."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function by Lentz's method."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + step * d, 1 + step / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return value


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def student_upper(t: float, df: float) -> float:
    """P(T > t)."""
    half = incomplete_beta(df / 2, 0.5, df / (df + t * t)) / 2
    return half if t > 0 else 1 - half


@F.pandas_udf(DoubleType())
def student_p_upper(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([student_upper(a, b) if pd.notna(a) and pd.notna(b) and b > 0 else None for a, b in zip(t, df)], dtype="float64")


@F.pandas_udf(DoubleType())
def student_p_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([2 * student_upper(abs(a), b) if pd.notna(a) and pd.notna(b) and b > 0 else None for a, b in zip(t, df)], dtype="float64")


@F.pandas_udf(DoubleType())
def normal_p_two_sided(t: pd.Series) -> pd.Series:
    return t.map(lambda x: math.erfc(abs(x) / math.sqrt(2)), na_action="ignore").astype("float64")


@F.pandas_udf(DoubleType())
def normal_p_upper(t: pd.Series) -> pd.Series:
    return t.map(lambda x: math.erfc(x / math.sqrt(2)) / 2, na_action="ignore").astype("float64")
