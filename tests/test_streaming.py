"""Streams against the batch operators: restarts, files out of order, late rows."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from barwise.operators.recursion import leaky_extrema
from barwise.plans import streams
from barwise.sources.bars import bars_of_ticks
from barwise.streaming.bars import latest, stream_bars
from barwise.streaming.levels import stream_leaky_extrema

START = dt.datetime(2024, 1, 1)
TICKS = "ts timestamp, event_id long, kind string, value double"
SIGNAL = "asset string, ts timestamp, log_close double, Z double"


def ticks(n=600, seed=0):
    rng = np.random.default_rng(seed)
    return [(START + dt.timedelta(minutes=int(m)), k, "ab"[k % 2], float(rng.normal())) for k, m in enumerate(rng.integers(0, 3000, n))]


def bars(df):
    return sorted((r.asset, r.ts, r.open, r.high, r.low, r.close, r.volume) for r in df.collect())


def test_bars_of_a_restarted_stream_equal_the_batch(spark, tmp_path):
    rows = ticks()
    want = bars(bars_of_ticks(spark.createDataFrame(rows, TICKS), F.col("kind"), F.col("value"), "hour", ["ts", "event_id"]))
    source, folder = str(tmp_path / "ticks"), str(tmp_path / "run")
    for part in (rows[:200], rows[200:400], rows[400:]):  # ticks of any hour in any file
        spark.createDataFrame(part, TICKS).coalesce(1).write.mode("append").parquet(source)
        stream = stream_bars(streams.files(spark, source, spark.read.parquet(source).schema, 1), F.col("kind"), F.col("value"), "1 hour", "10 days", ("ts", "event_id"))
        written = streams.drained(stream, folder, "update")  # each time a new query goes on from the checkpoint
    assert written.select("batch").distinct().count() >= 3
    assert bars(latest(written)) == want


def test_ticks_beyond_the_watermark_change_nothing(spark, tmp_path):
    source, folder = str(tmp_path / "ticks"), str(tmp_path / "run")
    late = (START, 99, "a", 1000.0)
    for part in ([(START, 1, "a", 1.0)], [(START + dt.timedelta(days=2), 2, "a", 2.0)], [late, (START + dt.timedelta(days=2), 3, "a", 3.0)]):
        spark.createDataFrame(part, TICKS).coalesce(1).write.mode("append").parquet(source)
        stream = stream_bars(streams.files(spark, source, spark.read.parquet(source).schema, 1), F.col("kind"), F.col("value"), "1 hour", "1 hour", ("ts", "event_id"))
        got = latest(streams.drained(stream, folder, "update"))
    assert [(r.ts, r.close, r.volume) for r in got.orderBy("ts").collect()] == [(START, 1.0, 1.0), (START + dt.timedelta(days=2), 3.0, 2.0)]


def signal(n=300):
    rng = np.random.default_rng(7)
    return [(a, START + dt.timedelta(hours=k), float(x), None if k % 41 == 3 else float(rng.normal())) for a in "AB" for k, x in enumerate(np.cumsum(rng.normal(scale=0.1, size=n)))]


def levels(df, ts=lambda t: t):
    return {(r.asset, r.fast, r.slow, ts(r.ts)): (r.leaky_resistance, r.leaky_support) for r in df.collect()}


def test_levels_of_a_restarted_stream_equal_the_batch(spark, tmp_path):
    rows, grid = signal(), [(1, 6), (3, 24)]
    want = levels(leaky_extrema(spark.createDataFrame(rows, SIGNAL).withColumn("ts", F.col("ts").cast("timestamp_ntz")), grid))
    source, folder = str(tmp_path / "signal"), str(tmp_path / "run")
    with streams.large_state(spark):
        for low, high in ((0, 100), (100, 160), (160, 300)):
            part = [r for r in rows if low <= (r[1] - START) / dt.timedelta(hours=1) < high]
            spark.createDataFrame(part[::-1], SIGNAL).coalesce(1).write.mode("append").parquet(source)
            stream = stream_leaky_extrema(streams.files(spark, source, spark.read.parquet(source).schema, 1), grid)
            got = streams.drained(stream, folder, "append")
    assert got.where("late").count() == 0
    made = levels(got)
    assert made.keys() == want.keys()
    for key, (r, s) in want.items():
        assert made[key] == ((None, None) if r is None else (pytest.approx(r, abs=1e-12), pytest.approx(s, abs=1e-12)))


def test_late_rows_come_out_marked_and_move_nothing(spark, tmp_path):
    source, folder = str(tmp_path / "signal"), str(tmp_path / "run")
    at = lambda h: START + dt.timedelta(hours=h)
    with streams.large_state(spark):
        for part in ([("A", at(0), 1.0, 0.0), ("A", at(2), 2.0, 0.0)], [("A", at(1), 50.0, 0.0), ("A", at(3), 2.0, 0.0), ("B", at(0), 5.0, 0.0)]):
            spark.createDataFrame(part, SIGNAL).coalesce(1).write.mode("append").parquet(source)
            stream = stream_leaky_extrema(streams.files(spark, source, spark.read.parquet(source).schema, 1), [(1, 2)])
            got = {(r.asset, r.ts): r for r in streams.drained(stream, folder, "append").collect()}
    assert got["A", at(1)].late and got["A", at(1)].leaky_resistance is None
    assert not got["A", at(3)].late and got["A", at(3)].leaky_resistance == 1.75 and got["B", at(0)].leaky_support == 5.0
