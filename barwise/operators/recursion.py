"""Leaky support and resistance: a recursion whose gain depends on its state, run over the chunks of a series side by side.

A row moves a level by an increasing function with one kink, at the row's price. Functions of that kind compose, so a
chunk of rows is an increasing function given by points between which it is straight. The chunks' functions are found
side by side, the levels at the chunks' ends follow from them in one short scan, and each chunk then runs from its level.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwise.operators.chunks import numbered
from barwise.operators.settle import settled


class LeakyState:
    """Both levels after the rows seen so far; they begin at the first row with price and signal, and move while Z is below zeta."""

    def __init__(self, fast: float, slow: float, zeta: float, levels: tuple[float, float] | None = None):
        self.fast, self.slow = fast, slow
        self.up, self.down, self.zeta, self.levels = 1 - 2 ** (-1 / fast), 1 - 2 ** (-1 / slow), zeta, levels

    def run(self, price: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = np.full((len(price), 2), np.nan)
        levels = self.levels
        for t, (p, q) in enumerate(zip(price.tolist(), z.tolist())):
            if p == p and q == q:  # neither is missing
                if levels is None:
                    levels = (p, p)
                if q < self.zeta:
                    r, s = levels
                    levels = (r + (self.up if p > r else self.down) * (p - r), s + (self.up if p < s else self.down) * (p - s))
            if levels is not None:
                out[t] = levels
        self.levels = levels
        return out[:, 0], out[:, 1]


def composed(prices: np.ndarray, above: np.ndarray, below: np.ndarray, low: float, high: float, flat: float = 1e-15) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pair of gains, the points (start, end) of the function from a level in [low, high] to the level after all prices.

    A level moves by `above` of its way to prices above it and by `below` to prices below it. A price between the ends of
    two points is a new kink. The ends draw together, so that prices rarely fall between them and the points stay few;
    points whose ends are equal (within `flat`) are dropped.
    """
    start = np.tile(np.array([low, high], dtype=float), (len(above), 1))
    end, used = start.copy(), np.full(len(above), 2)
    above, below = above[:, None], below[:, None]
    for step, p in enumerate(prices.tolist()):
        lower = end < p
        place = lower.sum(axis=1)
        for row in np.flatnonzero((place > 0) & (place < end.shape[1])):
            k = int(place[row])
            if end[row, k] > p:
                if used[row] == end.shape[1]:
                    start, end, lower = (np.concatenate([m, np.repeat(m[:, -1:], 64, axis=1)], axis=1) for m in (start, end, lower))
                share = (p - end[row, k - 1]) / (end[row, k] - end[row, k - 1])
                x = start[row, k - 1] + share * (start[row, k] - start[row, k - 1])
                for m, v in ((start, x), (end, p)):
                    m[row, k + 1 :] = m[row, k:-1].copy()
                    m[row, k] = v
                lower[row] = end[row] < p
                used[row] += 1
        end += np.where(lower, above, below) * (p - end)
        if step % 256 == 255 and end.shape[1] > 2:
            start, end, used = _pruned(start, end, used, flat)
    return [(start[k, : used[k]], end[k, : used[k]]) for k in range(len(used))]


def _pruned(start: np.ndarray, end: np.ndarray, used: np.ndarray, flat: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = []
    for x, y, n in zip(start, end, used):
        rises = np.diff(y[:n]) > flat
        keep = np.flatnonzero(np.concatenate([[True], rises]) | np.concatenate([rises, [True]]))
        rows.append((x[keep], y[keep]))
    used = np.array([len(x) for x, _ in rows])
    width = max(2, used.max())
    start, end = (np.array([np.concatenate([r[side], np.full(width - len(r[side]), r[side][-1])]) for r in rows]) for side in (0, 1))
    return start, end, np.maximum(used, 2)


def _gains(settings: list[tuple[float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """The gains towards prices above and below: of each setting's resistance, then of each one's support."""
    up, down = (1 - 2 ** (-1 / np.array([s[k] for s in settings], dtype=float)) for k in (0, 1))
    return np.concatenate([up, down]), np.concatenate([down, up])


def leaky_extrema(signal: DataFrame, settings: list[tuple[float, float]], zeta: float = 1.0, chunk_rows: int | None = None) -> DataFrame:
    """(asset, ts, fast, slow, leaky_resistance, leaky_support) for every (fast, slow) half-life in rows.

    A series is cut into chunks of `chunk_rows` rows (by default an eighth of the longest series, 65,536 at most), each a
    task that serves all settings. What goes from chunk to chunk is a few points a setting.
    """
    settings = [(float(a), float(b)) for a, b in settings]
    rows = settled(numbered(signal.select("asset", "ts", "log_close", "Z")))
    if chunk_rows is None:
        chunk_rows = min(65_536, max(64, -(-((rows.agg(F.max("rn")).first()[0] or 0) + 1) // 8)))
    live = F.when(F.col("log_close").isNotNull() & F.col("Z").isNotNull() & ~F.isnan("log_close") & ~F.isnan("Z"), F.col("log_close"))
    reach = rows.groupBy("asset").agg(F.min(live).alias("low"), F.max(live).alias("high"))
    cut = rows.withColumn("chunk", F.floor(F.col("rn") / chunk_rows)).join(F.broadcast(reach) if reach.count() <= 100_000 else reach, "asset")
    above, below = _gains(settings)

    def function(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        p, z = pdf["log_close"].to_numpy(float), pdf["Z"].to_numpy(float)
        there = ~np.isnan(p) & ~np.isnan(z)
        first = p[there][:1]
        points = composed(p[there & (z < zeta)], above, below, float(pdf["low"].iloc[0]), float(pdf["high"].iloc[0])) if len(first) else [((), ())] * len(above)
        return pd.DataFrame({"asset": pdf["asset"].iloc[0], "chunk": pdf["chunk"].iloc[0], "first": first[0] if len(first) else np.nan, "starts": [[list(x) for x, _ in points]], "ends": [[list(y) for _, y in points]]})

    def levels(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, now, before = pdf.sort_values("chunk"), np.full(len(above), np.nan), []
        for first, starts, ends in zip(pdf["first"], pdf["starts"], pdf["ends"]):
            before.append(list(now))
            if first == first:  # a series begins at its first price
                now = np.array([np.interp(first if x != x else x, s, e) for x, s, e in zip(now, starts, ends)])
        return pd.DataFrame({"asset": pdf["asset"], "chunk": pdf["chunk"], "levels": before})

    def replayed(pdf: pd.DataFrame, begin: pd.DataFrame) -> pd.DataFrame:
        pdf, at, parts = pdf.sort_values("ts", kind="stable"), begin["levels"].iloc[0], []
        for k, (fast, slow) in enumerate(settings):
            r, s = float(at[k]), float(at[len(settings) + k])
            r, s = LeakyState(fast, slow, zeta, None if r != r else (r, s)).run(pdf["log_close"].to_numpy(float), pdf["Z"].to_numpy(float))
            parts.append(pdf[["asset", "ts"]].assign(fast=fast, slow=slow, leaky_resistance=pd.array(r, "Float64"), leaky_support=pd.array(s, "Float64")))
        return pd.concat(parts)

    functions = cut.groupBy("asset", "chunk").applyInPandas(function, "asset string, chunk long, first double, starts array<array<double>>, ends array<array<double>>")
    begins = functions.groupBy("asset").applyInPandas(levels, "asset string, chunk long, levels array<double>")
    plain = cut.select("asset", "chunk", "ts", "log_close", "Z")
    return plain.groupBy("asset", "chunk").cogroup(begins.groupBy("asset", "chunk")).applyInPandas(replayed, "asset string, ts timestamp_ntz, fast double, slow double, leaky_resistance double, leaky_support double")


def extrema_errors(latched: DataFrame, leaky: DataFrame, by: list[str]) -> DataFrame:
    """(by..., n, errors and correlations of both levels, mean_mae) where latched and leaky levels are all there."""
    rows = latched.join(leaky, ["asset", "ts"]).where("resistance is not null and support is not null and leaky_resistance is not null and leaky_support is not null")
    each = [(k, F.col(a) - F.col(b), a, b) for k, a, b in (("r", "resistance", "leaky_resistance"), ("s", "support", "leaky_support"))]
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), *[x for k, d, a, b in each for x in (F.avg(F.abs(d)).alias(f"mae_{k}"), F.sqrt(F.avg(d * d)).alias(f"rmse_{k}"), F.corr(a, b).alias(f"corr_{k}"))])
    return out.withColumn("mean_mae", (F.col("mae_r") + F.col("mae_s")) / 2)


def calibrate(latched: DataFrame, fast: list[float], slow: list[float], zeta: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(grid, best): errors per (asset, split, fast, slow) with slow > fast, and each asset's setting of least validation error (the first wins ties)."""
    settings = [(a, b) for a in fast for b in slow if b > a]
    if not settings:
        raise ValueError("no setting with slow above fast")
    grid = extrema_errors(latched, leaky_extrema(latched, settings, zeta), ["asset", "split", "fast", "slow"])
    best = grid.where("split = 'validation'").groupBy("asset").agg(F.min_by(F.struct("fast", "slow"), F.struct("mean_mae", "fast", "slow")).alias("_b"), F.min("mean_mae").alias("validation_mae"))
    return grid, best.select("asset", "_b.fast", "_b.slow", "validation_mae")
