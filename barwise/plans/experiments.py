"""The experiments that string the operators together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwise.functions.scalars import minutes_to_schedule
from barwise.operators import asof, chunks, features, forecasting, inference, resampling, splits, summaries
from barwise.operators.settle import settled


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _same(horizons, frames: dict[str, int]) -> dict[int, str | None]:
    return {h: next((k for k, n in frames.items() if n == h), None) for h in horizons}


#: The published clips of Z, by quantiles of the training rows; the second is the default elsewhere.
CLIPS = (None, (0.005, 0.995), (0.01, 0.99), (0.025, 0.975))
TRAINING = ("train", "validation")


def clipped(rows: DataFrame, frame: DataFrame, clip: tuple[float, float] | None = CLIPS[1], ranges=splits.DAY_SPLITS, training=TRAINING, by=("asset",)) -> DataFrame:
    """`rows` with Z held within quantiles of `frame`'s training rows; without a clip, as they are."""
    if clip is None:
        return rows
    known = splits.in_split(frame.where("Z is not null"), training, ranges)
    return splits.winsorized(rows, splits.clip_bounds(known, "Z", *clip, by=by), "Z", by)


def with_bootstraps(table: DataFrame, detail: DataFrame, by: list[str], length: int, replicates: int, seed: int = 42) -> DataFrame:
    """Adds, for both loss differences, the moving-block bootstrap's interval and its share of means not above 0."""
    for name, offset in (("mse_diff", 0), ("qlike_diff", 10_000)):
        drawn = resampling.moving_block(detail, name, length, replicates, F.col("horizon") + seed + offset, by)
        table = table.join(drawn.select(*by, *[F.col(c).alias(f"{name}_boot_{k}") for c, k in (("ci_low", "low"), ("ci_high", "high"), ("p_nonpositive", "p"))]), by, "left")
    return table


def family_tests(frame: DataFrame, horizons: tuple[int, ...], frames: dict[str, int], families=tuple(forecasting.FAMILIES), ranges=splits.DAY_SPLITS) -> DataFrame:
    """Every family with and without Z, at every horizon: losses and tests."""
    long = settled(clipped(forecasting.by_horizon(frame, horizons, tuple(frames)), frame, ranges=ranges))
    return forecasting.comparison(forecasting.details(long, tuple(frames), _same(horizons, frames), [forecasting.Nested(f, f) for f in families], splits=ranges)).orderBy("asset", "horizon", "family")


def selected_family(frame: DataFrame, horizons: tuple[int, ...], frames: dict[str, int], ranges=splits.DAY_SPLITS, loss: str = "qlike") -> DataFrame:
    """Each asset's and horizon's family of least validation loss, then refitted with the validation rows and tested."""
    long = settled(clipped(forecasting.by_horizon(frame, horizons, tuple(frames)), frame, ranges=ranges))
    setting = (long, tuple(frames), _same(horizons, frames), [forecasting.Nested(f, f) for f in forecasting.FAMILIES])
    best = settled(forecasting.best_family(forecasting.details(*setting, train=("train",), test=("validation",), splits=ranges), loss))
    chosen = forecasting.details(*setting, splits=ranges).join(best, ["asset", "horizon", "family"], "left_semi")
    return forecasting.comparison(chosen).join(best, ["asset", "horizon", "family"]).orderBy("asset", "horizon")


def specification_sweep(frame: DataFrame, horizons: tuple[int, ...], frames: dict[str, int], clips=CLIPS, specs=("log_smear", "log_no_smear", "level_floor"), block_length: int = 24, replicates: int = 1000, ranges=splits.DAY_SPLITS) -> DataFrame:
    """The static test under every specification and clip of Z, with bootstraps of both loss differences."""
    long = forecasting.by_horizon(frame, horizons, tuple(frames))
    parts = [clipped(long, frame, clip, ranges).withColumn("clip", F.lit("none" if clip is None else f"{clip[0]}-{clip[1]}")) for clip in clips]
    models = [forecasting.Nested(spec, spec=spec) for spec in specs]
    detail = settled(forecasting.details(settled(_union(parts)), tuple(frames), _same(horizons, frames), models, splits=ranges, gates=(50, 10), also=("clip",)))
    by = ["asset", "horizon", "clip", "family"]
    table = with_bootstraps(forecasting.comparison(detail, law="normal", by=by), detail, by, block_length, replicates)
    return table.withColumnRenamed("family", "spec").withColumn("family", F.lit("HAR")).orderBy("asset", "horizon", "clip", "spec")


def real_moments(returns: DataFrame, ranges=splits.DAY_SPLITS, batches: int = 100, replicates: int = 500) -> DataFrame:
    """(asset, split, statistic, value, SE by day blocks, by week blocks and by batches, with their numbers) of returns in every range."""
    rows = settled(splits.with_split(returns, ranges).where("split is not null and ret is not null").select("asset", "split", "ts", "ret"))
    by, keys = ("asset", "split"), ["asset", "split", "statistic"]
    values = summaries.moment_table(rows, "ret", by).select(*by, F.expr("stack(4, 'mean', mean, 'std', std, 'skewness', skewness, 'kurtosis', kurtosis) as (statistic, value)"))
    for name, days, seed in (("daily", 1, 42), ("weekly", 7, 43)):
        drawn = resampling.calendar_block(rows, "ret", days, replicates, seed, by)
        values = values.join(drawn.select(*keys, F.col("boot_se").alias(f"{name}_se"), F.col("blocks").alias(f"{name}_blocks")), keys, "left")
    by_batch = inference.batch_means(rows, "ret", batches, by).select(*keys, "batch_se", "batches")
    return values.join(by_batch, keys, "left")


RATE = ("abs_rate_z", "rate_change_bps")
#: By name: the columns of the smaller model beside HAR's, and those that the larger one adds.
RATE_PAIRS = {"HAR+F": ((), RATE), "HAR+Z": ((), ("Z",)), "HAR+F+Z": ((), (*RATE, "Z")), "HAR+F+Z+window": ((), (*RATE, "Z", "in_window")), "HAR+F+Z vs HAR+F": (RATE, ("Z",)), "HAR+F+Z vs HAR+Z": (("Z",), RATE)}


def rate_models(signal: DataFrame, events: DataFrame, horizons: tuple[int, ...], frames: dict[str, int] | None = None, tolerance_minutes: float = 60, history: int = 90, by: tuple[str, ...] = (), ties: tuple[str, ...] = ("funding_time", "event_id"), ranges=splits.HOUR_SPLITS) -> DataFrame:
    """Five nested models on common rows: HAR, with rate features, with Z, with both, and with the window flag too.

    Events are one series for all assets, or one for each key of `by`.
    """
    frames = frames or {"d": 24, "w": 48, "m": 96}
    scored = features.event_features(events, history, by=by, order=ties).withColumn("known_at", F.col("funding_time"))
    joined = asof.asof_backward(signal, scored, "ts", "known_at", ["abs_rate_z", "rate_change_bps"], list(by), list(ties))
    near = asof.gap_to_nearest(joined, events, "ts", "funding_time", "minutes_to_event", tolerance_minutes, list(by))
    flagged = near.withColumn("in_window", F.col("minutes_to_event").isNotNull().cast("double")).drop("minutes_to_event")
    framed = lambda rows, keys: features.with_har(features.with_realized_variance(rows, horizons, keys), frames, keys)
    whole = chunks.in_chunks(flagged, framed, back=max(*horizons, *frames.values()), ahead=max(horizons))
    long = forecasting.by_horizon(whole, horizons, tuple(frames), ("Z", *RATE, "in_window"))
    long = clipped(long, whole, ranges=ranges)
    long = settled(splits.complete(long, ["Z", *RATE, "rv_future"], ["rv_future"]))
    pairs = [forecasting.Nested(name, "HAR", extra, base) for name, (base, extra) in RATE_PAIRS.items()]
    detail = forecasting.details(long, tuple(frames), _same(horizons, frames), pairs, splits=ranges)
    return forecasting.comparison(detail).withColumnRenamed("family", "model").orderBy("asset", "horizon", "model")


def margin_efficiency(frame: DataFrame, horizons: tuple[int, ...], frames: dict[str, int], alphas: tuple[float, ...] = (0.05, 0.10), ranges=splits.DAY_SPLITS) -> DataFrame:
    """The margins that HAR with and without Z need at matched validation coverage, by asset and horizon."""
    long = settled(clipped(forecasting.by_horizon(frame, horizons, tuple(frames)), frame, ranges=ranges))
    setting = (long, tuple(frames), _same(horizons, frames), [forecasting.Nested("HAR")])
    known = forecasting.details(*setting, train=("train",), test=("validation",), splits=ranges)
    return forecasting.margin_table(known, forecasting.details(*setting, splits=ranges), alphas)


def rate_window_effect(signal: DataFrame, events: DataFrame, minutes: float = 60, history: int = 90, by: tuple[str, ...] = (), ties: tuple[str, ...] = ("funding_time",), ranges=splits.DAY_SPLITS, test: str = "test") -> DataFrame:
    """Z within `minutes` of a rate event against Z elsewhere on the test rows: effect size, Welch's test, and Z's correlation with the newest event's z-score."""
    scored = features.event_features(events, history, by=by, order=ties)
    rows = splits.in_split(signal, test, ranges).select("asset", "ts", "Z")
    near = asof.gap_to_nearest(rows, events, "ts", "funding_time", "gap", minutes, list(by))
    known = settled(asof.asof_backward(near, scored, "ts", "funding_time", ["abs_rate_z"], list(by), list(ties)).withColumn("inside", F.col("gap").isNotNull()).where("Z is not null"))
    other = known.groupBy("asset").agg(F.avg("Z").alias("mean_all"), F.corr("Z", "abs_rate_z").alias("corr_abs_rate_z"))
    return summaries.effect_size(known, "Z", "inside").drop("corr").join(other, "asset").orderBy("asset")


def signal_sensitivity(returns: DataFrame, horizons: tuple[int, ...], frames: dict[str, int], windows=(144, 288, 576), smoothings=(1, 3, 6), poolings=("max", "mean"), ranges=splits.DAY_SPLITS) -> DataFrame:
    """The HAR comparison under every window, smoothing and pooling of the signal.

    One pass over the series gives the variances and the signals of all settings as columns; the settings then are keys of
    the rows, so however many there are the plan is one.
    """
    settings = [(w, s, p) for w in windows for s in smoothings for p in poolings]

    def made(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
        return features.with_activations(features.with_har(features.with_realized_variance(rows, horizons, by), frames, by), settings, by)

    back = max(max(windows) + max(smoothings) + 1, *frames.values(), *horizons)
    wide = settled(chunks.in_chunks(returns, made, back=back, ahead=max(horizons)))
    keys = ("window", "smoothing", "pooling")
    each = F.array(*[F.struct(F.lit(w).alias("window"), F.lit(s).alias("smoothing"), F.lit(p).alias("pooling"), F.col(f"Z_{w}_{s}_{p}").alias("Z")) for w, s, p in settings])
    tagged = wide.select("asset", "ts", *[c for c in wide.columns if "rv_" in c], F.inline(each))
    long = forecasting.by_horizon(tagged, horizons, tuple(frames), ("Z", *keys))
    long = settled(clipped(long, tagged, ranges=ranges, by=("asset", *keys)))
    detail = forecasting.details(long, tuple(frames), _same(horizons, frames), [forecasting.Nested("HAR")], splits=ranges, also=keys)
    return forecasting.comparison(detail, by=("asset", "horizon", *keys, "family")).orderBy("asset", "horizon", *keys)


def calibration(bars: DataFrame, split_ranges, window: int, days_per_row: float, horizons=(12, 48, 144, 288), acf_max_lag: int = 300, fast=(1, 3, 6, 12, 24), slow=(72, 144, 288, 576, 1008, 2016), batches: int = 100, replicates: int = 500) -> dict[str, DataFrame]:
    """The calibration run's tables by name: every table is over all its splits, with the fits and settings of the training rows and of validation."""
    from barwise.operators import recursion

    def made(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        signal = features.with_activation(features.with_returns(rows, keys), window, by=keys)
        return features.with_realized_variance(features.with_quiet_extrema(signal, 1.0, window, keys), horizons, keys)

    frame = settled(splits.with_split(chunks.in_chunks(bars, made, back=max(2 * window + 4, *horizons), ahead=max(horizons)), split_ranges))
    quiet = frame.drop(*[c for c in frame.columns if c.startswith("rv_")])
    shown = frame.where("split in ('train', 'validation', 'test', 'recent')")
    fits = settled(inference.first_order_fit(frame.where("split = 'train'"), "Z", days_per_row))
    acf = settled(inference.acf_errors(inference.autocorrelations(shown.select("asset", "split", "ts", "Z"), "Z", acf_max_lag, ("asset", "split")), fits, ("asset", "split")))
    latched = features.latched(quiet).where("split is not null")
    grid, best = recursion.calibrate(latched.select("asset", "ts", "split", "log_close", "Z", "resistance", "support"), list(fast), list(slow))
    grid = settled(grid)
    each = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit(min(288, max(1, 2 * h))).alias("lags"), F.col(f"rv_past_{h}").alias("rv_past"), F.col(f"rv_future_{h}").alias("rv_future")) for h in horizons])
    regressed = settled(frame.where("split in ('validation', 'test', 'recent')").select("asset", "split", "ts", "Z", F.inline(each)))
    hac = inference.hac_regression(regressed, "rv_future", ["Z", "rv_past"], "lags", ("asset", "split", "horizon", "lags"))
    at = {f"{c}_{name}": F.col(column)[k] for c, column in (("coef", "coef"), ("t", "t_hac"), ("p", "p_hac")) for k, name in ((1, "z"), (2, "past_rv"))}
    return {
        "data_coverage": summaries.coverage(bars, split_ranges),
        "ou_calibration": fits,
        "ou_oos_diagnostics": inference.first_order_check(shown, fits, "Z", ("asset", "split")),
        "ou_acf_diagnostics": acf,
        "ou_acf_summary": inference.acf_summary(acf, ("asset", "split")),
        "leaky_grid_search": grid,
        "leaky_extrema_calibration": grid.join(best.select("asset", "fast", "slow"), ["asset", "fast", "slow"], "left_semi"),
        "volatility_prediction_hac": hac.select("asset", "split", "horizon", "n", *[c.alias(name) for name, c in at.items()], "r2"),
        "return_moments_robust_se": real_moments(frame.select("asset", "ts", "ret"), split_ranges, batches, replicates).where("split in ('train', 'validation', 'test', 'recent')"),
        "scheduled_window": frame.where("Z is not null").groupBy("asset", (minutes_to_schedule("ts") <= 60).alias("in_window")).agg(F.avg("Z").alias("mean_z"), F.count("*").alias("n")),
    }
