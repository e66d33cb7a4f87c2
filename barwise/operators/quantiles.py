"""Exact quantiles by radix selection, so that no task ever holds a group.

A double becomes a 64-bit integer that sorts as the double does. A pass counts the values of each group by their next 16
bits, in at most 65,536 bins; a running total over the bins tells in which one a wanted rank lies, and the next pass
looks at that bin only. After four passes every bit is known. A bin that has become small is sorted as it is.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from barwise.operators.settle import settled

_SIGN = np.int64(0x7FFF_FFFF_FFFF_FFFF)


@F.pandas_udf(LongType())
def ordered_bits(x: pd.Series) -> pd.Series:
    """A long that sorts as the double: -0.0 equals 0.0, NaN stands last."""
    bits = np.where(np.isnan(x), np.nan, x.to_numpy(float) + 0.0).view(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ _SIGN, bits))


@F.pandas_udf(DoubleType())
def from_ordered_bits(k: pd.Series) -> pd.Series:
    bits = k.to_numpy(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ _SIGN, bits).view(float))


def _at_ranks(held: DataFrame, ranks: DataFrame, small: int) -> DataFrame:
    """(g, c, rank, k): of the values (g, c, k), the one at each wanted (g, c, rank), ranks counting from 0."""
    found = None
    wanted = ranks.select("g", "c", "rank", F.col("rank").alias("left"), F.lit(0).cast("long").alias("prefix"))
    level = held.withColumn("prefix", F.lit(0).cast("long"))
    for shift in (48, 32, 16, 0):
        # the first 16 bits are signed, the others follow them
        digit = F.shiftright("k", shift) if shift == 48 else F.shiftright("k", shift).bitwiseAND(65_535)
        counts = level.groupBy("g", "c", "prefix", digit.alias("bin")).agg(F.count("*").alias("n"))
        before = Window.partitionBy("g", "c", "prefix").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        bins = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        inside = (F.col("left") >= F.col("before")) & (F.col("left") < F.col("before") + F.col("n"))
        met = wanted.join(bins, ["g", "c", "prefix"]).where(inside)
        prefix = F.col("bin") if shift == 48 else F.shiftleft("prefix", 16).bitwiseOR(F.col("bin"))
        wanted = settled(met.select("g", "c", "rank", (F.col("left") - F.col("before")).alias("left"), prefix.cast("long").alias("prefix"), "n"))
        if shift == 0:
            return _both(found, wanted.select("g", "c", "rank", F.col("prefix").alias("k")))
        live = wanted.select("g", "c", "prefix", F.col("n").alias("_n")).distinct()
        # the values that share a wanted rank's bits so far
        level = held.withColumn("prefix", F.shiftright("k", shift)).join(live, ["g", "c", "prefix"])
        few = level.where(F.col("_n") <= small).groupBy("g", "c", "prefix").agg(F.array_sort(F.collect_list("k")).alias("ks"))
        done = wanted.where(F.col("n") <= small).join(few, ["g", "c", "prefix"])
        found = _both(found, done.select("g", "c", "rank", F.col("ks")[F.col("left").cast("int")].alias("k")))
        wanted = wanted.where(F.col("n") > small).drop("n")
        if wanted.isEmpty():
            return found
        level = settled(level.where(F.col("_n") > small).drop("_n"))


def _both(a: DataFrame | None, b: DataFrame) -> DataFrame:
    return b if a is None else a.unionByName(b)


def quantiles(df: DataFrame, wanted: dict[str, tuple[str | Column, float]], by=(), small: int = 20_000) -> DataFrame:
    """(by..., name...): for each name the quantile of its (column, share), linear between ranks, over non-null values.

    Groups of any size cost one pass of at most 65,536 bins and a look at the bins with the wanted ranks; only bins of at
    most `small` values are sorted. A group without a value gives null, NaN counts as the greatest value.
    """
    by = list(by)
    columns: dict[str, Column] = {}
    places = {}
    for name, (x, share) in wanted.items():
        x = F.col(x) if isinstance(x, str) else x
        places[name] = (list(columns).index(str(x)) if str(x) in columns else len(columns), share)
        columns.setdefault(str(x), x)
    group = F.struct(*[F.col(c) for c in by], F.lit(0).alias("_"))
    each = F.array(*[F.struct(F.lit(i).alias("c"), x.cast("double").alias("x")) for i, x in enumerate(columns.values())])
    long = df.select(group.alias("g"), F.inline(each))
    held = settled(long.where("x is not null").select("g", "c", ordered_bits("x").alias("k")))
    sizes = settled(held.groupBy("g", "c").agg(F.count("*").alias("n")))
    asked = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(c).alias("of"), F.lit(float(share)).alias("share")) for name, (c, share) in places.items()])
    h = F.col("share") * (F.col("n") - 1)
    spots = settled(sizes.select("g", "c", "n", F.inline(asked)).where("c = of").select("g", "c", "name", F.floor(h).alias("low"), F.least(F.floor(h) + 1, F.col("n") - 1).alias("high"), (h - F.floor(h)).alias("part")))
    ranks = spots.select("g", "c", F.explode(F.array("low", "high")).alias("rank")).distinct()
    values = _at_ranks(held, ranks, small).select("g", "c", "rank", from_ordered_bits("k").alias("x"))
    ends = spots.select("g", "c", "name", "part", F.posexplode(F.array("low", "high")).alias("end", "rank")).join(values, ["g", "c", "rank"])
    low, high = (F.max(F.when(F.col("end") == e, F.col("x"))) for e in (0, 1))
    made = ends.groupBy("g", "name").agg(F.when(F.max("part") == 0, low).otherwise(low * (1 - F.max("part")) + high * F.max("part")).alias("q"))
    wide = made.groupBy("g").agg(*[F.max(F.when(F.col("name") == name, F.col("q"))).alias(name) for name in wanted])
    groups = df.select(group.alias("g")).distinct() if by else None
    return wide.select(*[F.col(f"g.{c}").alias(c) for c in by], *wanted) if groups is None else groups.join(wide, "g", "left").select(*[F.col(f"g.{c}").alias(c) for c in by], *wanted)
