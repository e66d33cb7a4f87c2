"""Operators against plain pandas, published results and each other."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barwise.functions.distributions import student_upper
import barwise.__main__ as command
from barwise.functions import rolling
from barwise.operators import asof, chunks, features, inference, resampling, summaries
from barwise.sources import bars as sources
from barwise.sources import runs

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def bars(spark):
    rows = [("X", START + dt.timedelta(days=k), 100 + (k * 37 % 11) + k / 50, float(k * 13 % 7)) for k in range(150)]
    return spark.createDataFrame(rows, "asset string, ts timestamp_ntz, close double, volume double")


def test_activation_is_full_window_and_looks_back_only(spark, bars):
    signal = features.with_activation(features.with_returns(bars), 10)
    got = [r.Z for r in signal.orderBy("ts").collect()]
    assert got[:12] == [None] * 12 and got[13] is not None  # the first return is missing, then 10 rows, then 2 for smoothing
    later = bars.withColumn("close", F.when(F.col("ts") > START + dt.timedelta(days=80), F.col("close") * 3).otherwise(F.col("close")))
    changed = [r.Z for r in features.with_activation(features.with_returns(later), 10).orderBy("ts").collect()]
    assert changed[:81] == got[:81] and changed[82:] != got[82:]


def test_future_variance_is_past_variance_later(bars):
    rows = features.with_realized_variance(features.with_returns(bars), (3,)).orderBy("ts").collect()
    assert all(a.rv_future_3 == pytest.approx(b.rv_past_3) for a, b in zip(rows[1:], rows[4:]))
    assert rows[2].rv_past_3 is None and rows[-1].rv_future_3 is None


def test_chunks_equal_whole_series(bars):
    f = lambda df, by=("asset",): features.with_activation(features.with_returns(df, by), 10, by=by)
    whole = {r.ts: r.Z for r in f(bars).collect()}
    cut = {r.ts: r.Z for r in chunks.in_chunks(bars, f, back=13, rows=40).collect()}
    assert whole.keys() == cut.keys()
    assert all(cut[k] == (None if v is None else pytest.approx(v)) for k, v in whole.items())


def test_asof_and_tolerance_against_pandas(spark):
    at = lambda m: START + dt.timedelta(minutes=m)
    left = spark.createDataFrame([(at(m),) for m in (0, 10, 20, 100)], "ts timestamp_ntz")
    right = spark.createDataFrame([(at(5), 1, 1.0), (at(20), 2, 2.0), (at(20), 3, 3.0), (at(40), 4, 4.0)], "t timestamp_ntz, id long, x double")
    joined = {r.ts: r.x for r in asof.asof_backward(left, right, "ts", "t", ["x"], ties=["id"]).collect()}
    assert joined == {at(0): None, at(10): 1.0, at(20): 3.0, at(100): 3.0 + 1}
    near = {r.ts: r.gap for r in asof.gap_to_nearest(left, right, "ts", "t", "gap", 60).collect()}
    assert near == {at(0): 5.0, at(10): 5.0, at(20): 0.0, at(100): 60.0}


def test_csv_bars(spark, tmp_path):
    text = "Datetime,Open,High,Low,Close,Volume\n2024-01-01 00:00:00,1,1,1,5,2\n2024-01-01 00:00:00,1,1,1,6,2\nbad,1,1,1,5,2\n2024-01-01 00:05:00,x,1,1,7,-1\n2024-01-01 00:10:00,1,1,1,,3\n"
    (tmp_path / "x.csv").write_text(text)
    rows = sources.read_bars(spark, str(tmp_path / "x.csv"), "X").orderBy("ts").collect()
    assert [(r.close, r.open, r.volume) for r in rows] == [(5.0, 1.0, 2.0), (7.0, None, -1.0)]
    (tmp_path / "y.csv").write_text("Datetime,Close\n2024-01-01,1\n")
    with pytest.raises(ValueError, match="missing columns"):
        sources.read_bars(spark, str(tmp_path / "y.csv"), "Y")


def test_student_tail():
    assert student_upper(2.228138851964939, 10) == pytest.approx(0.025, abs=1e-9)
    assert student_upper(-1.0, 5) == pytest.approx(1 - student_upper(1.0, 5))


def test_split_edges_and_types(spark):
    assert pd.Timestamp(START).year == 2024
    from barwise.operators.splits import with_split

    rows = spark.createDataFrame([(dt.datetime(1998, 12, 31, 23, 59, 59),), (dt.datetime(1998, 12, 31, 23, 59, 59, 500000),)], "ts timestamp_ntz")
    assert [r.split for r in with_split(rows).orderBy("ts").collect()] == ["train", None]


def test_moving_average_and_quarters_against_pandas(spark):
    values = pd.Series([float(k * 37 % 101) for k in range(1000)])
    frame = spark.createDataFrame(list(enumerate(values)), "step long, x double")
    want = values.rolling(50).mean().dropna()
    got = summaries.moving_average(frame, "x", 50, (), rows=120)
    assert [r.average for r in got.orderBy("step").collect()] == pytest.approx(want.tolist())
    q = summaries.quarter_means(got.withColumn("path_id", F.lit(1))).first()
    n = len(want)
    assert (q.first, q.last) == (pytest.approx(want[: n // 4].mean()), pytest.approx(want[n * 3 // 4 :].mean()))


def test_lag_sums_over_spans_equal_numpy(spark):
    rng = np.random.default_rng(1)
    days = np.cumsum(rng.integers(1, 20, 300))
    x, y = rng.normal(size=(2, 300))
    rows = [("X", START + dt.timedelta(days=int(d)), float(a), float(b)) for d, a, b in zip(days, x, y)] + [(None, START, 2.0, 3.0)]
    frame = spark.createDataFrame(rows, "asset string, ts timestamp_ntz, x double, y double")
    got = {(r.asset, r.lag): r for r in inference.lagged_sums(frame, ["x", "y"], 40).collect()}
    assert len(got) == 42 and got[None, 0].x_y == 6.0
    for lag in range(41):
        assert got["X", lag].x_y == pytest.approx(x[: 300 - lag] @ y[lag:]) and got["X", lag].y_x == pytest.approx(y[: 300 - lag] @ x[lag:])


def test_asof_over_spans_by_key(spark):
    rng = np.random.default_rng(2)
    at = lambda: START + dt.timedelta(minutes=int(rng.integers(0, 300_000)))
    left = [(a, at(), k) for k in range(400) for a in "xy"] + [("x", None, 999)]
    right = [(a, at(), k) for k in range(25) for a in "xyz"]
    l, r = spark.createDataFrame(left, "a string, ts timestamp_ntz, k long"), spark.createDataFrame(right, "a string, t timestamp_ntz, e long")
    joined = {(x.a, x.k): x.e for x in asof.asof_backward(l, r, "ts", "t", ["e"], ["a"], ["t"]).collect()}
    gaps = {(x.a, x.k): x.gap for x in asof.gap_to_nearest(l, r, "ts", "t", "gap", 5000, ["a"]).collect()}
    assert len(joined) == len(gaps) == len(left)
    for a, ts, k in left:
        own = [(t, e) for b, t, e in right if b == a]
        before = [(t, e) for t, e in own if ts is not None and t <= ts]
        assert joined[a, k] == (max(before)[1] if before else None)
        near = min((abs((t - ts).total_seconds()) / 60 for t, _ in own), default=None) if ts is not None else None
        assert gaps[a, k] == (pytest.approx(near) if near is not None and near <= 5000 else None)


def test_carried_values_equal_one_window(bars):
    gaps = bars.withColumn("x", F.when(F.dayofmonth("ts") == 17, F.col("close")))
    got = {r.ts: r.last for r in chunks.with_last(gaps, {"last": "x"}).collect()}
    held = None
    for r in gaps.orderBy("ts").collect():
        held = r.x if r.x is not None else held
        assert got[r.ts] == held


def test_files_of_a_run(spark, tmp_path):
    head = " Timestamp ,Close,Volume\n"
    (tmp_path / "btc_5m.csv").write_text(head + "2024-01-01 00:00:00,5,2\n2024-01-01 00:00:00,6,2\n2024-01-01 00:05:00,-1,2\n2024-01-01 00:10:00,7,1\n")
    raw = runs.read_raw(spark, str(tmp_path), "BTC")
    assert raw.columns == ["Timestamp", "Close", "Volume"] and runs.read_raw(spark, str(tmp_path), "ETH") is None
    assert [(r.close, round(r.ret, 6)) for r in runs.prepared(raw, "BTC").collect()] == [(7.0, 0.154151)]
    assert runs.chosen_assets(["eth:x.csv"]) == {"ETH": "x.csv"} and list(runs.chosen_assets()) == ["BTC", "ETH"] and len(runs.chosen_assets(all_assets=True)) == 4
    assert runs.read_assets(spark, str(tmp_path), {"NO": "no.csv"}) is None
    liquidity = [spark.createDataFrame(rows, "asset string, mean_notional double, rank int, top_two boolean") for rows in ([("A", 5.0, 1, True)], [("A", 1.0, 1, True), ("B", 9.0, 1, True), ("C", 2.0, 1, True)])]
    assert [(r.asset, r.mean_notional, r["rank"], r.top_two) for r in runs.combined_liquidity(liquidity).collect()] == [("B", 9.0, 1, True), ("A", 5.0, 2, True), ("C", 2.0, 3, False)]


def test_files_in_order(spark, tmp_path):
    for k, rows in enumerate((["2024-01-01 00:00:00,1,1,1,5,2"] * 2, ["2024-01-01 00:00:00,1,1,1,6,2"] * 3000)):
        (tmp_path / f"{k}.csv").write_text("Datetime,Open,High,Low,Close,Volume\n" + "\n".join(rows) + "\n")
    assert [r.close for r in sources.read_bars(spark, str(tmp_path), "X").collect()] == [5.0]
    last = sources.clean_bars(spark.read.option("header", True).csv(str(tmp_path)), "X", keep="last")
    assert [r.close for r in last.collect()] == [6.0]


def test_command_line_of_calibration_and_oos(spark, tmp_path):
    rng = np.random.default_rng(0)
    times = pd.date_range("2023-11-01", periods=4000, freq="5min").append(pd.date_range("2024-12-25", periods=4000, freq="5min"))
    price = 100 * np.exp(np.cumsum(rng.normal(0, 0.001, len(times))))
    pd.DataFrame({"Datetime": times, "Open": price, "High": price, "Low": price, "Close": price, "Volume": rng.integers(1, 99, len(times))}).to_csv(tmp_path / "btcusdt_5m.csv", index=False)
    args = command.arguments(["calibrate", "--data-dir", str(tmp_path), "--assets", "BTC:btcusdt_5m.csv", "NO:no.csv"])
    made = command.tables(spark, args)
    assert [r.asset for r in made["data_coverage"].collect()] == ["BTC"] and made["ou_calibration"].count() == 1
    assert made["return_moments_robust_se"].count() == 12
    assert {"ou_acf_summary", "volatility_prediction_hac", "leaky_extrema_calibration"} < made.keys()
    assert {(r.split, r.max_lag) for r in made["ou_acf_summary"].collect()} == {(k, 300) for k in ("train", "validation", "test")}
    assert {(r.split, r.horizon) for r in made["volatility_prediction_hac"].collect()} == {(k, h) for k in ("validation", "test") for h in (12, 48, 144, 288)}
    assert command.tables(spark, command.arguments(["oos", "--data-dir", str(tmp_path), "--assets", "NO:no.csv"])) == {}


def test_hac_regression_against_numpy(spark):
    rng = np.random.default_rng(5)
    n, lags = 250, 7
    x = rng.normal(size=(n, 2))
    e = np.convolve(rng.normal(size=n + 3), [1, 0.6, 0.3, 0.1], "valid")
    y = 1 + x @ [0.5, -0.2] + e
    frame = spark.createDataFrame([("X", START + dt.timedelta(days=k), float(y[k]), *map(float, x[k])) for k in range(n)] + [("X", START, None, 1.0, 1.0)], "asset string, ts timestamp_ntz, y double, a double, b double")
    got = inference.hac_regression(frame, "y", ["a", "b"], lags).first()
    design = np.column_stack([np.ones(n), x])
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    u = design * (y - design @ beta)[:, None]
    s = u.T @ u + sum((1 - k / (lags + 1)) * (u[k:].T @ u[:-k] + u[:-k].T @ u[k:]) for k in range(1, lags + 1))
    inverse = np.linalg.inv(design.T @ design)
    t = beta / np.sqrt(np.diag(inverse @ s @ inverse))
    assert got.n == n and got.coef == pytest.approx(beta) and got.t_hac == pytest.approx(t)
    assert got.p_hac == pytest.approx([math.erfc(abs(v) / math.sqrt(2)) for v in t])


def test_newey_west_p_values(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(0.1, 1, 90)
    frame = spark.createDataFrame([("X", START + dt.timedelta(days=k), float(v)) for k, v in enumerate(x)], "asset string, ts timestamp_ntz, x double")
    c, lags = x - x.mean(), 9
    lrv = (c @ c + 2 * sum((1 - k / (lags + 1)) * (c[k:] @ c[:-k]) for k in range(1, lags + 1))) / 90
    t = x.mean() / math.sqrt(lrv / 90)
    student, normal = (inference.newey_west(frame, "x", law=law).first() for law in ("t", "normal"))
    assert student.t == pytest.approx(t) and student.lags == lags
    assert normal.p == pytest.approx(math.erfc(t / math.sqrt(2)) / 2) and student.p == pytest.approx(student_upper(t, 89))


def test_moving_block_bootstrap_against_resampled_rows(spark):
    x = [float(k * 13 % 29) for k in range(50)]
    frame = spark.createDataFrame([("X", 5, START + dt.timedelta(days=k), v) for k, v in enumerate(x)], "asset string, horizon int, ts timestamp_ntz, x double")
    got = resampling.moving_block(frame, "x", 8, 40, F.col("horizon") + 42, ["asset", "horizon"]).first()
    lcg = lambda r, b: ((((r * 1_000_003 + b * 7_919 + 47) * 1_103_515_245 + 12_345) % 2**31) * 1_103_515_245 + 12_345) % 2**31
    means = []
    for r in range(40):
        drawn = [v for b in range(7) for v in x[lcg(r, b) % 43 :][:8]][:50]
        means.append(sum(drawn) / 50)
    assert (got.ci_low, got.ci_high) == (pytest.approx(np.quantile(means, 0.025)), pytest.approx(np.quantile(means, 0.975)))
    assert got.p_nonpositive == np.mean(np.array(means) <= 0)


def test_long_frames_by_blocks_are_as_exact_as_sums(spark):
    rng = np.random.default_rng(7)
    r2 = rng.normal(0, 1e-3, 20_000) ** 2
    r2[50] = 1e9  # totals past this row would lose all digits of what follows
    frame = spark.createDataFrame([("X", START + dt.timedelta(minutes=5 * k), float(v)) for k, v in enumerate(r2)], "asset string, ts timestamp_ntz, x double")
    rows = rolling.with_long_sums(frame, {"s": ("x", 2016), "t": ("x", 3)}).orderBy("ts").collect()
    for name, n in (("s", 2016), ("t", 3)):
        want = [None] * (n - 1) + [math.fsum(r2[k : k + n]) for k in range(20_000 - n + 1)]
        assert all(r[name] == (None if v is None else pytest.approx(v, rel=1e-12)) for r, v in zip(rows, want))


def test_result_files_and_sinks(spark, tmp_path):
    part = lambda a, x: spark.createDataFrame([(a, x)], "asset string, x double")
    for a, x in (("A", 1.0), ("B", 2.0), ("A", 3.0)):
        sources.write_table(part(a, x), str(tmp_path / "t"), append=True)
    assert sorted((r.asset, r.x) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [("A", 3.0), ("B", 2.0)]
    sources.write_table(part("C", 4.0), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
    (tmp_path / "r.csv").write_text("Asset,Horizon_bars,Gain\neth,12,0.01\nbtc,48,0.02\nbtc,12,0.03\n")
    rows = sources.read_results(spark, [str(tmp_path / "r.csv")], {"asset": (), "horizon_bars": (), "gain_percent": ("Gain",)}, ("gain_percent",)).collect()
    assert [(r.asset, r.horizon_bars, round(r.gain_percent, 9)) for r in rows] == [("BTC", 12, 3.0), ("BTC", 48, 2.0), ("ETH", 12, 1.0)]
    with pytest.raises(ValueError, match="missing"):
        sources.read_results(spark, [str(tmp_path / "r.csv")], {"nothing": ()})
    assert sources.parse_assets(["btc:a:b.csv"], {"ETH": "e.csv"}) == {"ETH": "e.csv", "BTC": "a:b.csv"}
    with pytest.raises(ValueError):
        sources.parse_assets(["btc"])


def test_a_dense_month_is_parted_evenly(spark):
    """All events in one month, a third of them of one key: the ranges hold about as many rows each, and joins stay right."""
    n = 60_000
    events = spark.range(n).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 40).cast("string"))).alias("a"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 40).cast("timestamp_ntz").alias("t"), F.col("id").alias("e"))
    bars = events.where("e % 5 = 0").select("a", (F.col("t") + F.expr("interval 1 second")).alias("ts"), F.col("e").alias("want"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one partition
    try:
        line = asof._line(bars, events, "ts", "t", F.struct("e"), ["a"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in line.groupBy("_span").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * sum(sizes) / len(sizes)
    got = asof.asof_backward(bars, events, "ts", "t", ["e"], ["a"], ["t"])
    assert got.where("e = want").count() == got.count() == n // 5


def test_any_statistic_over_drawn_blocks_and_batches(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=70)
    rows = [("X", START + dt.timedelta(hours=9 * k), float(v)) for k, v in enumerate(x)]
    frame = spark.createDataFrame(rows[::-1], "asset string, ts timestamp_ntz, x double")
    chosen = {"median": resampling.median, "lag one": resampling.lag_one}
    got = {r.statistic: r for r in resampling.calendar_statistics(frame, "x", chosen, 3, 20, 43).collect()}
    days = [(t.date() - START.date()).days // 3 for _, t, _ in rows]
    blocks = [x[[k for k, d in enumerate(days) if d == b]] for b in sorted(set(days))]
    picks = resampling.drawn(np.arange(20), len(blocks), 43) % len(blocks)
    for name, f in chosen.items():
        each = [f(np.concatenate([blocks[p] for p in row])) for row in picks]
        assert got[name].estimate == pytest.approx(f(x)) and got[name].boot_se == pytest.approx(np.std(each, ddof=1)) and got[name].blocks == len(blocks)
    cut = {r.statistic: r for r in resampling.batch_statistics(frame, "x", chosen, 6).collect()}
    each = [resampling.median(x[k * 11 : k * 11 + 11]) for k in range(6)]
    assert cut["median"].estimate == pytest.approx(np.mean(each)) and cut["median"].batch_se == pytest.approx(np.std(each, ddof=1) / math.sqrt(6)) and cut["median"].batches == 6


def test_block_sums_lose_no_digits():
    rng = np.random.default_rng(9)
    x = rng.normal(size=500)
    x[3] = 1e16
    for n in (1, 7, 64, 500):
        want = [math.fsum(x[k : k + n]) for k in range(500 - n + 1)]
        assert resampling.frame_sums(x, n)[4:] == pytest.approx(want[4:], rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("chunk", [16, 23, 1000])
def test_moving_block_over_chunks(spark, chunk):
    x = [float(k * 13 % 29) for k in range(100)]
    frame = spark.createDataFrame([(a, START + dt.timedelta(days=k), v) for a in ("X", None) for k, v in enumerate(x)], "asset string, ts timestamp_ntz, x double")
    rows = resampling.moving_block(frame, "x", 8, 40, 42, chunk_rows=chunk, at_once=30).collect()
    starts = resampling.drawn(np.arange(40), 13, 42) % 93
    means = [sum(v for b, s in enumerate(row) for v in x[s:][: 8 if b < 12 else 4]) / 100 for row in starts]
    assert len(rows) == 2
    for r in rows:
        assert (r.ci_low, r.ci_high) == (pytest.approx(np.quantile(means, 0.025)), pytest.approx(np.quantile(means, 0.975))) and r.mean == pytest.approx(np.mean(x))


def test_many_files_are_one_scan(spark, tmp_path):
    head = "Datetime,Open,High,Low,Close,Volume\n"
    files = {f"A{k}": f"a{k}_5m.csv" for k in range(40)} | {"GONE": "gone.csv"}
    for k in range(40):
        body = head + "".join(f"2024-01-01 00:{5 * j:02d}:00,1,1,1,{k + j},2\n" for j in range(3))
        if k == 7:  # the same columns in another order
            body = "Close,Datetime,Open,High,Low,Volume\n7,2024-01-01 00:00:00,1,1,1,2\n"
        if k == 9:
            body = "no,bars\n1,2\n"
        (tmp_path / f"a{k}_5m.csv").write_text(body)
    (tmp_path / "other.csv").write_text(head + "2024-01-01 00:00:00,1,1,1,99,2\n")
    rows, aside = runs.scanned(spark, str(tmp_path), files, sources.ALIASES, tuple(sources.ALIASES))
    assert aside == ["a9_5m.csv"]
    assert rows._jdf.queryExecution().executedPlan().toString().count("FileScan csv") == 1
    with pytest.warns(UserWarning, match="missing columns: a9_5m.csv"):
        got = runs.read_assets(spark, str(tmp_path), files)
    counts = {r.asset: (r.n, r.first) for r in got.groupBy("asset").agg(F.count("*").alias("n"), F.min("close").alias("first")).collect()}
    assert counts == {f"A{k}": (3, float(k)) for k in range(40) if k not in (7, 9)} | {"A7": (1, 7.0)}
    assert runs.read_assets(spark, str(tmp_path / "nowhere"), files) is None
    for k in range(3):
        (tmp_path / f"r{k}.csv").write_text(f"datetime,last_funding_rate\n2024-01-01,0.{k}\n2024-01-01,0.9\nbad,1\n")
    rates = runs.read_rate_files(spark, str(tmp_path), {f"R{k}": f"r{k}.csv" for k in range(4)})
    assert sorted((r.asset, r.last_funding_rate, r.funding_interval_hours) for r in rates.collect()) == [("R0", 0.0, None), ("R1", 0.1, None), ("R2", 0.2, None)]


def test_reset_of_an_earlier_run(spark, tmp_path):
    path = str(tmp_path / "t")
    sources.write_table(spark.createDataFrame([("A", 1.0), ("B", 2.0), ("C d", 3.0)], "asset string, x double"), path, append=True)
    sources.reset_assets(spark, path, ["A", "C d", "no"])
    assert [(r.asset, r.x) for r in spark.read.parquet(path).collect()] == [("B", 2.0)]


def test_command_line_of_robustness(spark, tmp_path):
    rng = np.random.default_rng(3)
    times = pd.date_range("2024-12-20", periods=8000, freq="5min")
    price = 100 * np.exp(np.cumsum(rng.normal(0, 0.001, len(times))))
    for asset in ("btc", "eth"):
        pd.DataFrame({"Datetime": times, "Open": price, "High": price, "Low": price, "Close": price, "Volume": rng.integers(1, 99, len(times))}).to_csv(tmp_path / f"{asset}usdt_5m.csv", index=False)
    events = pd.date_range("2024-12-20", periods=80, freq="8h")
    pd.DataFrame({"datetime": events, "last_funding_rate": rng.normal(size=80)}).to_csv(tmp_path / "btcusdt_funding.csv", index=False)
    skips = ["--skip-hyperparameter", "--skip-margin", "--skip-pooled"]
    args = command.arguments(["robustness", "--data-dir", str(tmp_path), "--funding-dir", str(tmp_path), *skips])
    assert args.margin_targets == [0.05, 0.10] and command.arguments(["robustness", "--margin-targets", "0.01"]).margin_targets == [0.01]
    made = command.tables(spark, args)
    assert made.keys() == {"ex_ante_liquidity_2024", "funding_window_effect_size"} and made["ex_ante_liquidity_2024"].count() == 2
    (row,) = made["funding_window_effect_size"].collect()
    assert row.asset == "BTC" and row.n_inside > 0 and row.n_inside + row.n_outside > 4000 and 0 <= row.welch_p <= 1 and row.corr_abs_rate_z is not None
    assert command.tables(spark, command.arguments(["robustness", "--data-dir", str(tmp_path), "--skip-funding-effect", "--skip-liquidity", *skips])) == {}
    pools = {r.pool: r.n for r in command._pools(spark).groupBy("pool").agg(F.count("*").alias("n")).collect()}
    assert pools == {"Primary_BTC_ETH": 2, "Robustness_XRP_SOL": 2, "All_assets": 4}
