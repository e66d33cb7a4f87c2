"""Block bootstraps in which rows and draws stay where they are.

Draws come from an integer formula of (seed, replicate, block), the same wherever it is computed. A task that holds some
blocks of a series so finds by itself how often each is drawn in each replicate; what it sends on is one row of sums a
replicate.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwise.functions.scalars import ratio
from barwise.operators.chunks import numbered
from barwise.operators.inference import batched
from barwise.operators.settle import settled


def draw(replicate: Column, block: Column, seed: int | Column) -> Column:
    """A number from 0 to 2^31 - 1: two rounds of a linear congruence over the key."""
    first = ((replicate * 1_000_003 + block * 7_919 + seed) * 1_103_515_245 + 12_345) % 2_147_483_648
    return (first * 1_103_515_245 + 12_345) % 2_147_483_648


def drawn(replicates: np.ndarray, blocks: int, seed: int) -> np.ndarray:
    """draw() of every block (across) of the given replicates (down)."""
    key = replicates.astype(np.int64)[:, None] * 1_000_003 + np.arange(blocks, dtype=np.int64)[None, :] * 7_919 + seed
    for _ in range(2):
        key = (key % 2_147_483_648 * 1_103_515_245 + 12_345) % 2_147_483_648
    return key


def frame_sums(x: np.ndarray, n: int) -> np.ndarray:
    """Sums of every n neighbours, each the end of one block of n and the beginning of the next: no difference of totals."""
    if n <= 0 or len(x) < n:
        return np.zeros(len(x) + 1 if n <= 0 else 0)
    blocks = np.concatenate([x, np.zeros(-len(x) % n)]).reshape(-1, n)
    begun, left = blocks.cumsum(axis=1).ravel(), blocks[:, ::-1].cumsum(axis=1)[:, ::-1].ravel()
    start = np.arange(len(x) - n + 1)
    return np.where(start % n == 0, left[start], left[start] + begun[start + n - 1])


def moving_block(df: DataFrame, value: str, length: int, replicates: int, seed: int | Column = 42, by=("asset",), chunk_rows: int = 65_536, at_once: int = 4_000_000) -> DataFrame:
    """(by..., n, mean, ci_low, ci_high, p_nonpositive) of means over overlapping blocks, cut off at n rows.

    A chunk of a series, with the rows that its last blocks reach, sums its own blocks and gives each replicate the sum of
    those drawn. Neither rows nor draws are shuffled, and a long series is as many tasks as it has chunks. The seed may be a
    column made of the keys.
    """
    by = list(by)
    keyed = df.where(F.col(value).isNotNull()).select(*by, "ts", F.col(value).cast("double").alias("x"), (F.lit(seed) if isinstance(seed, int) else seed).cast("long").alias("seed"))
    rows = settled(numbered(keyed, by=by))
    sizes = settled(rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.first("seed").alias("seed")))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    known = sizes.select(*[F.col(c).alias(f"_{c}") for c in by], "n")
    homes = F.sequence(F.greatest(F.lit(0), F.floor((F.col("rn") - length) / chunk_rows)), F.floor(F.col("rn") / chunk_rows))
    spread = rows.join(known, same).select(*by, "rn", "x", "seed", "n", F.explode(homes).alias("chunk"))

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn")
        n, first, chosen = int(pdf["n"].iloc[0]), int(pdf["chunk"].iloc[0]) * chunk_rows, int(pdf["seed"].iloc[0])
        x = pdf["x"].to_numpy(float)
        own = min(length, n)
        blocks = -(-n // own)
        last = n - (blocks - 1) * own  # the last block is cut off
        whole, cut = frame_sums(x, own), frame_sums(x, last)
        total = np.zeros(replicates)
        for low in range(0, replicates, max(1, at_once // blocks)):
            some = np.arange(low, min(replicates, low + max(1, at_once // blocks)))
            start = drawn(some, blocks, chosen) % (n - own + 1) - first
            here = (start >= 0) & (start < chunk_rows)
            for part, sums in ((slice(None, -1), whole), (slice(-1, None), cut)):
                who, which = np.nonzero(here[:, part])
                total[some] += np.bincount(who, sums[start[:, part][who, which]], len(some))
        return pd.DataFrame({**{c: pdf[c].iloc[0] for c in by}, "replicate": np.arange(replicates), "s": total})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.select(*by).schema)
    sums = spread.groupBy(*by, "chunk").applyInPandas(summed, f"{kinds + ', ' if by else ''}replicate int, s double")
    means = sums.groupBy(*by, "replicate").agg(F.sum("s").alias("s")).join(known, same).select(*by, (F.col("s") / F.col("n")).alias("m"))
    bounds = means.groupBy(*by).agg(F.percentile("m", 0.025).alias("ci_low"), F.percentile("m", 0.975).alias("ci_high"), F.avg((F.col("m") <= 0).cast("double")).alias("p_nonpositive"))  # a group has `replicates` rows
    of = bounds.select(*[F.col(c).alias(f"_{c}") for c in by], "ci_low", "ci_high", "p_nonpositive")
    return sizes.join(of, same).select(*by, "n", "mean", "ci_low", "ci_high", "p_nonpositive")


def _placed(df: DataFrame, value: str, days: int, by: list[str]) -> DataFrame:
    """(by..., ts, x, centre, bin): each row's block of `days`, counted from the series' first day, and the series' mean."""
    rows = df.where(F.col(value).isNotNull()).select(*by, "ts", F.to_date("ts").alias("day"), F.col(value).cast("double").alias("x"))
    starts = rows.groupBy(*by).agg(F.min("day").alias("first"), F.avg("x").alias("centre"))
    return rows.join(starts, by).withColumn("bin", F.floor(F.datediff("day", "first") / days)).drop("day", "first")


def calendar_block(df: DataFrame, value: str, days: int, replicates: int, seed: int = 42, by=("asset",), a_task: int = 50) -> DataFrame:
    """(by..., statistic, boot_se, blocks): deviation over replicates that draw whole blocks of `days`, counted from the first day.

    A block is its power sums about the overall mean. The replicates' sums are a product of two matrices, how often each
    block is drawn times the blocks' power sums, in a task for every `a_task` replicates; a series has one block a day at most.
    """
    by = list(by)
    c = F.col("x") - F.col("centre")
    blocks = _placed(df, value, days, by).withColumn("c", c).groupBy(*by, "bin").agg(F.count("*").cast("double").alias("s0"), *[F.sum(F.pow("c", F.lit(k))).alias(f"s{k}") for k in (1, 2, 3, 4)])
    matrix = settled(blocks.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", F.array(*[f"s{k}" for k in range(5)]).alias("s")))), lambda b: b["s"]).alias("sums")))
    shared = matrix.withColumn("low", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1), F.lit(a_task)))).repartition(*by, "low")

    def product(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                powers = np.array([list(s) for s in row["sums"]], dtype=float)
                some = np.arange(row["low"], min(replicates, row["low"] + a_task))
                picks = drawn(some, len(powers), seed) % len(powers)
                weights = np.zeros((len(some), len(powers)))
                np.add.at(weights, (np.arange(len(some))[:, None], picks), 1.0)
                sums = weights @ powers
                yield pd.DataFrame({**{k: [row[k]] * len(some) for k in by}, "blocks": len(powers), **{f"s{k}": sums[:, k] for k in range(5)}})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in matrix.select(*by).schema)
    sums = shared.mapInPandas(product, f"{kinds + ', ' if by else ''}blocks long, {', '.join(f's{k} double' for k in range(5))}")
    m = [F.col(f"s{k}") / F.col("s0") for k in range(5)]
    var = m[2] - m[1] * m[1]
    third = m[3] - 3 * m[1] * m[2] + 2 * m[1] * m[1] * m[1]
    fourth = m[4] - 4 * m[1] * m[3] + 6 * m[1] * m[1] * m[2] - 3 * m[1] * m[1] * m[1] * m[1]
    each = sums.select(*by, "blocks", m[1].alias("mean"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("std"), ratio(third, F.pow(var, F.lit(1.5))).alias("skewness"), ratio(fourth, var * var).alias("kurtosis"))
    long = each.select(*by, "blocks", F.expr("stack(4, 'mean', mean, 'std', std, 'skewness', skewness, 'kurtosis', kurtosis) as (statistic, x)"))
    return long.groupBy(*by, "statistic").agg(F.stddev_samp("x").alias("boot_se"), F.first("blocks").alias("blocks"))


Statistic = Callable[[np.ndarray], float]


def median(x: np.ndarray) -> float:
    return float(np.median(x))


def lag_one(x: np.ndarray) -> float:
    """The correlation of neighbours; none of a series that does not vary."""
    a, b = x[:-1], x[1:]
    return float(np.corrcoef(a, b)[0, 1]) if len(x) > 2 and a.std() > 0 and b.std() > 0 else float("nan")


def _stated(df: DataFrame, keys: list[str], order: list[str], statistics: dict[str, Statistic]) -> DataFrame:
    """(keys..., statistic, x): each statistic of a group's values in order; one that is not a number is null."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)

    def stated(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf.sort_values(order, kind="stable")["x"].to_numpy(float)
        found = pd.array([f(values) for f in statistics.values()], "Float64")
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] * len(found) for c in keys}, "statistic": list(statistics), "x": pd.Series(found).where(np.isfinite(found.to_numpy(float, na_value=np.nan)))})

    return df.groupBy(*keys).applyInPandas(stated, f"{kinds}, statistic string, x double")


def calendar_statistics(df: DataFrame, value: str, statistics: dict[str, Statistic], days: int, replicates: int, seed: int = 42, by=("asset",)) -> DataFrame:
    """(by..., statistic, estimate, boot_se, blocks) of any statistics of a series' values in order of time.

    A replicate is the rows of its drawn blocks, one after the other. A function needs all of them, so a replicate of a
    series is one group of about its rows; series and replicates are as many groups.
    """
    by = list(by)
    placed = settled(_placed(df, value, days, by))
    bins = placed.select(*by, "bin").distinct()
    listed = settled(numbered_by(bins, by, "bin", "pick"))
    sizes = listed.groupBy(*by).agg(F.count("*").alias("blocks"))
    rows = placed.join(listed, [*by, "bin"]).select(*by, "pick", "ts", "x")
    draws = (
        sizes.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .withColumn("pick", draw(F.col("replicate"), F.col("block"), seed) % F.col("blocks"))
    )
    each = _stated(draws.join(rows, [*by, "pick"]).select(*by, "replicate", "block", "ts", "x"), [*by, "replicate"], ["block", "ts"], statistics)
    spread = each.groupBy(*by, "statistic").agg(F.stddev_samp("x").alias("boot_se"))
    whole = _stated(placed.select(*by, "ts", "x"), by, ["ts"], statistics).withColumnRenamed("x", "estimate")
    return whole.join(spread, [*by, "statistic"]).join(sizes, by).select(*by, "statistic", "estimate", "boot_se", "blocks")


def numbered_by(df: DataFrame, by: list[str], order: str, name: str) -> DataFrame:
    """Adds the place from 0 of each row of a short list in order; a list has one row a calendar block."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(order)).cast("long") - 1)


def batch_statistics(df: DataFrame, value: str, statistics: dict[str, Statistic], batches: int = 100, by=("asset",)) -> DataFrame:
    """(by..., statistic, estimate, batch_se, batches) of any statistics over equal runs of rows; the tail is left out."""
    by = list(by)
    each = _stated(batched(df, value, batches, by).select(*by, "_batch", "ts", F.col(value).cast("double").alias("x")), [*by, "_batch"], ["ts"], statistics)
    return each.groupBy(*by, "statistic").agg(F.avg("x").alias("estimate"), (F.stddev_samp("x") / F.sqrt(F.count("x"))).alias("batch_se"), F.count("x").alias("batches"))
