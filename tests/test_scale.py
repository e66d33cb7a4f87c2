"""Operators that cut long series and groups: exact quantiles, extremes, the leaky scan, lag sums by spectra."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barwise.functions.rolling import framed, shifted_z, with_extremes, with_shifted_z
from barwise.operators import inference, recursion
from barwise.operators.quantiles import from_ordered_bits, ordered_bits, quantiles

START = dt.datetime(2024, 1, 1)


@given(st.lists(st.floats(allow_nan=False), min_size=2, max_size=60))
@settings(deadline=None)
def test_bits_sort_as_doubles(values):
    bits = ordered_bits.func(pd.Series(values))
    assert from_ordered_bits.func(bits).tolist() == [v + 0.0 for v in values]
    assert [values[k] for k in np.argsort(bits, kind="stable")] == [values[k] for k in np.argsort(values, kind="stable")]


@pytest.mark.parametrize("small", [1, 50, 20_000])
def test_quantiles_equal_numpy(spark, small):
    rng = np.random.default_rng(4)
    groups = {
        "wide": rng.normal(size=800) * 10.0 ** rng.integers(-200, 200, 800), "ties": rng.integers(0, 3, 500).astype(float), "near": 1 + rng.random(700) * 1e-14, "negative": -rng.random(300),
        "zeros": np.array([0.0, -0.0, 0.0, 5e-324, -5e-324]), "one": np.array([3.5]), None: np.array([1.0, 2.0, 4.0]), "huge": np.array([1e308, -1e308, np.inf]),
    }
    rows = [(g, float(x), 2 * float(x)) for g, values in groups.items() for x in values] + [("empty", None, None), ("ties", None, None)]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(5)
    wanted = {f"q{k}": ("x", q) for k, q in enumerate((0, 0.005, 0.25, 0.5, 0.9, 0.995, 1))} | {"double": (F.col("y"), 0.25)}
    got = {r.g: r for r in quantiles(df, wanted, ["g"], small).collect()}
    assert got.keys() == {*groups, "empty"} and got["empty"].q3 is None
    huge = groups.pop("huge")  # NumPy's own steps overflow there
    assert [got["huge"][f"q{k}"] for k in (0, 3, 6)] == sorted(huge)
    for g, values in groups.items():
        for k, q in enumerate((0, 0.005, 0.25, 0.5, 0.9, 0.995, 1)):
            assert got[g][f"q{k}"] == pytest.approx(np.quantile(values, q), rel=1e-12, abs=1e-320)
        assert got[g].double == pytest.approx(2 * np.quantile(values, 0.25), rel=1e-12, abs=1e-320)


def test_quantiles_of_all_rows_and_of_none(spark):
    df = spark.range(1001).select((F.col("id") * 1.5).alias("x"))
    assert quantiles(df, {"m": ("x", 0.5)}).collect()[0].m == 750.0
    assert quantiles(df.limit(0), {"m": ("x", 0.5)}).collect() == []


def test_no_quantile_group_is_gathered(spark):
    """A group of which a third is one value is counted in bins; nothing but small bins is collected."""
    df = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id") * 1.0).alias("x"))
    got = quantiles(df, {"low": ("x", 0.2), "mid": ("x", 0.5)}, small=100).first()
    x = np.where(np.arange(60_000) % 3 == 0, 7.0, np.arange(60_000))
    assert (got.low, got.mid) == (np.quantile(x, 0.2), np.quantile(x, 0.5))


@pytest.mark.parametrize("n", [1, 2, 7, 24, 500])
def test_extremes_equal_frames(spark, n):
    rng = np.random.default_rng(n)
    rows = [(a, START + dt.timedelta(hours=k), None if rng.random() < 0.3 else float(rng.normal())) for a in ("X", "Y", None) for k in range(130)]
    df = spark.createDataFrame(rows, "asset string, ts timestamp_ntz, x double")
    direct = df.withColumns({"a": framed(F.max, "x", 1 - n, 0, least=1), "b": framed(F.min, "x", 1 - n, 0, least=1)})
    linear = with_extremes(df, {"a": ("x", "max"), "b": ("x", "min")}, n)
    assert sorted(map(str, direct.collect())) == sorted(map(str, linear.collect()))


@pytest.mark.parametrize("n", [1, 3, 24, 90])
def test_block_scores_equal_framed_scores(spark, n):
    rng = np.random.default_rng(n)
    x = 1000 + rng.normal(size=220)
    x[100:160] = 1000.1  # a run that does not vary gives null
    rows = [(a, START + dt.timedelta(hours=k), None if k in (7, 60) else float(v)) for a in ("X", "Y") for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "asset string, ts timestamp_ntz, x double")
    want = {(r.asset, r.ts): r.z for r in df.withColumn("z", shifted_z("x", n)).collect()}
    got = {(r.asset, r.ts): r.z for r in with_shifted_z(df, {"z": "x"}, n).collect()}
    assert got.keys() == want.keys() and any(v is not None for v in want.values()) == (n > 1)
    flat = {START + dt.timedelta(hours=k) for k in range(100 + n, 161)}  # the plain frames' rounding leaves tiny deviations there
    for key, v in want.items():
        assert got[key] is None if key[1] in flat or v is None else got[key] == pytest.approx(v, rel=1e-7, abs=1e-9)


def walk(n, seed=0):
    rng = np.random.default_rng(seed)
    price, z = np.cumsum(rng.normal(scale=0.01, size=n)), rng.normal(size=n)
    return [(START + dt.timedelta(hours=k), None if rng.random() < 0.02 else float(p), None if k < 30 or rng.random() < 0.02 else float(q)) for k, (p, q) in enumerate(zip(price, z))]


@pytest.mark.parametrize("rows_a_chunk", [64, 97, 10_000])
def test_leaky_chunks_equal_one_pass(spark, rows_a_chunk):
    grid = [(1, 6), (1, 288), (24, 168), (3, 4)]
    feeds = {"X": walk(900), "Y": walk(500, 1), "Z": [(t, p, None) for t, p, _ in walk(200, 2)], "flat": [(t, 1.0, 0.0) for t, _, _ in walk(150)]}
    df = spark.createDataFrame([(a, *r) for a, feed in feeds.items() for r in feed], "asset string, ts timestamp_ntz, log_close double, Z double").repartition(6)
    got = {(r.asset, r.fast, r.slow, r.ts): (r.leaky_resistance, r.leaky_support) for r in recursion.leaky_extrema(df, grid, 1.0, rows_a_chunk).collect()}
    assert len(got) == 4 * sum(map(len, feeds.values()))
    for a, feed in feeds.items():
        nan = lambda x: np.nan if x is None else x
        p, z = (np.array([nan(r[k]) for r in feed]) for k in (1, 2))
        for fast, slow in grid:
            r, s = recursion.LeakyState(fast, slow, 1.0).run(p, z)
            for (t, _, _), x, y in zip(feed, r, s):
                assert got[a, fast, slow, t] == ((None, None) if x != x else (pytest.approx(x, abs=1e-12), pytest.approx(y, abs=1e-12)))


def test_a_series_is_several_tasks(spark):
    df = spark.createDataFrame([("X", *r) for r in walk(900)], "asset string, ts timestamp_ntz, log_close double, Z double")
    cut = []
    original = recursion.settled
    recursion.settled = lambda df: cut.append(original(df)) or cut[-1]
    try:
        recursion.leaky_extrema(df, [(2, 24)]).count()
    finally:
        recursion.settled = original
    longest = cut[0].agg(F.max("rn")).first()[0] + 1
    assert longest / max(64, -(-longest // 8)) > 7


def test_lag_products_equal_direct_sums():
    rng = np.random.default_rng(3)
    for n, ahead, most, block in ((1, 0, 0, 8192), (5, 4, 8, 8192), (200, 50, 50, 64), (1000, 300, 300, 128), (70, 400, 400, 64)):
        x = rng.normal(size=(n + ahead, 2)) * [1, 1e-4]
        got = inference.lagged_products(x[:n], x, most, block)
        want = np.array([x[: len(x[k : k + n])].T @ x[k : k + n] for k in range(most + 1)])
        assert np.abs(got - want).max() < 1e-12 * np.abs(want).max()
