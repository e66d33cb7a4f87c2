"""Single-pass summaries of bars, events, losses and paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwise.functions.distributions import student_p_two_sided
from barwise.functions.scalars import ratio, underprediction
from barwise.operators.chunks import in_chunks, numbered
from barwise.operators.inference import moments, newey_west
from barwise.operators.quantiles import quantiles
from barwise.operators.settle import settled
from barwise.operators.splits import with_split


def coverage(bars: DataFrame, splits, seconds_per_bar: int = 300) -> DataFrame:
    """One row per asset: first and last time, rows, missing bars within gaps, bars without volume, rows per split."""
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    gapped = lambda df, keys: df.withColumn("_gap", micros(F.col("ts")) - micros(F.lag("ts").over(Window.partitionBy(*keys).orderBy("ts"))))
    bar = seconds_per_bar * 1_000_000
    rows = with_split(in_chunks(bars, gapped, back=1), splits)
    missing = F.coalesce(F.sum(F.when(F.col("_gap") > bar, F.col("_gap") / bar - 1)), F.lit(0.0)).cast("long")
    return rows.groupBy("asset").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n_rows"), missing.alias("missing_bars"), F.count_if(F.col("volume") == 0).alias("zero_volume_bars"), *[F.count_if(F.col("split") == k).alias(f"{k}_rows") for k, _, _ in splits])


def moment_table(df: DataFrame, value: str, by=("asset",)) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), *[f.alias(k) for k, f in moments(value).items()])


def liquidity(bars: DataFrame, year: int) -> DataFrame:
    """Mean, median and total daily notional of a year, ranked by the mean; ties go by asset."""
    days = bars.where(F.year("ts") == year).groupBy("asset", F.to_date("ts").alias("day")).agg(F.sum(F.col("close") * F.col("volume")).alias("notional"), F.count("*").alias("bars"))
    each = days.groupBy("asset").agg(F.avg("notional").alias("mean_notional"), F.median("notional").alias("median_notional"), F.sum("notional").alias("total_notional"), F.count("*").alias("n_days"), F.sum("bars").alias("n_bars"))
    rank = F.row_number().over(Window.orderBy(F.desc("mean_notional"), "asset"))  # one row per asset
    return each.withColumn("rank", rank).withColumn("top_two", F.col("rank") <= 2)


def flag_means(df: DataFrame, by: list[str], flag: str) -> DataFrame:
    """Means of losses, of Z and of the outcome in and out of a window."""
    return df.groupBy(*by, flag).agg(
        F.count("*").alias("n"), F.avg("Z").alias("mean_z"), F.avg("rv_future").alias("mean_future_rv"),
        F.avg("mse_diff").alias("mean_mse_diff"), F.avg("qlike_diff").alias("mean_qlike_diff"), (1 - ratio(F.avg("augmented_mse"), F.avg("baseline_mse"))).alias("mse_improvement"),
    )


def activation_summary(df: DataFrame, flag: str, other: str, by=("asset",)) -> DataFrame:
    """Means of Z overall, inside and outside of the flag, the flag's share, and Z's correlation with the flag and with `other`."""
    inside = F.col(flag)
    return df.where("Z is not null").groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("Z").alias("mean_z"), F.avg(F.when(inside, F.col("Z"))).alias("mean_z_inside"), F.avg(F.when(~inside, F.col("Z"))).alias("mean_z_outside"),
        F.avg(inside.cast("double")).alias("share_inside"), F.corr("Z", inside.cast("double")).alias("corr_flag"), F.corr("Z", other).alias("corr_other"),
    )


def effect_size(df: DataFrame, value: str, flag: str, by=("asset",)) -> DataFrame:
    """Difference of means inside and outside, pooled deviation, Cohen's d, Welch's t, its degrees of freedom and p."""
    inside = lambda f, yes: f(F.when(F.col(flag) if yes else ~F.col(flag), F.col(value)))
    g = df.where(F.col(value).isNotNull()).groupBy(*by).agg(*[inside(f, yes).alias(f"{k}{n}") for yes, n in ((True, 1), (False, 2)) for k, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))], F.corr(value, F.col(flag).cast("double")).alias("corr"))
    n1, n2, v1, v2 = F.col("n1"), F.col("n2"), F.col("v1"), F.col("v2")
    sd = F.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / F.greatest(F.lit(1), n1 + n2 - 2))
    enough = (n1 > 2) & (n2 > 2)
    a, b = v1 / F.nullif(n1, F.lit(0)), v2 / F.nullif(n2, F.lit(0))
    diff = F.col("m1") - F.col("m2")
    out = g.withColumns({"diff": diff, "cohen_d": ratio(diff, sd), "welch_t": F.when(enough, ratio(diff, F.sqrt(a + b))), "welch_df": F.when(enough, ratio((a + b) * (a + b), a * a / (n1 - 1) + b * b / (n2 - 1)))})
    return out.withColumn("welch_p", student_p_two_sided("welch_t", "welch_df")).select(*by, F.col("n1").alias("n_inside"), F.col("n2").alias("n_outside"), F.col("m1").alias("mean_inside"), F.col("m2").alias("mean_outside"), "diff", "cohen_d", "welch_t", "welch_df", "welch_p", "corr")


def high_ranking(detail: DataFrame, q: float = 0.9, by=("asset", "horizon", "family"), least: int = 20) -> DataFrame:
    """How well each model's top forecasts hold the top outcomes: one row per group and model."""
    by = list(by)
    long = detail.select(*by, "rv_future", F.expr("stack(2, 'baseline', baseline_forecast, 'augmented', augmented_forecast) as (model, f)"))
    keys = [*by, "model"]
    sizes = long.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    cuts = quantiles(long, {"_cut_y": ("rv_future", q), "_cut_f": ("f", q)}, keys)
    rows = long.join(sizes.join(cuts, keys), keys).withColumns({"_top_y": F.col("rv_future") >= F.col("_cut_y"), "_top_f": F.col("f") >= F.col("_cut_f"), "_under": underprediction("rv_future", "f")})
    return rows.groupBy(*keys).agg(
        F.first("n").alias("n"),
        ratio(F.avg(F.when(F.col("_top_f"), F.col("rv_future"))), F.avg("rv_future")).alias("top_over_all"),
        ratio(F.count_if(F.col("_top_f") & F.col("_top_y")).cast("double"), F.count_if("_top_y").cast("double")).alias("recall"),
        F.avg("_under").alias("mean_under"),
        F.avg(F.when(F.col("_top_y"), F.col("_under"))).alias("tail_under"),
    )


def pooled_series(detail: DataFrame, pools: DataFrame, loss: str) -> DataFrame:
    """(pool, horizon, ts, x): loss differences averaged over the pool's assets at each time.

    Squared errors are first divided by the asset's mean baseline loss at the horizon. `pools` is (pool, asset); pools may overlap.
    """
    w = Window.partitionBy("asset", "horizon")
    x = F.col("qlike_diff") if loss == "qlike" else ratio(F.col("mse_diff"), F.avg("baseline_mse").over(w))
    return detail.withColumn("x", x).join(pools, "asset").groupBy("pool", "horizon", "ts").agg(F.avg("x").alias("x"), F.count("*").alias("n_assets"))


def pooled_tests(detail: DataFrame, pools: DataFrame, lags: int | None = None) -> DataFrame:
    """Newey-West tests of both losses for every pool and horizon."""
    detail = settled(detail)
    tests = [newey_west(pooled_series(detail, pools, k), "x", ("pool", "horizon"), ("ts",), lags).withColumn("loss", F.lit(k)) for k in ("mse", "qlike")]
    return tests[0].unionByName(tests[1])


#: The published pools of assets; they overlap.
POOLS = {"Primary_BTC_ETH": ("BTC", "ETH"), "Robustness_XRP_SOL": ("XRP", "SOL"), "All_assets": ("BTC", "ETH", "XRP", "SOL")}


def pooled_table(detail: DataFrame, pools: DataFrame, lags: int | None = None) -> DataFrame:
    """(pool, horizon, loss, n_origins, raw_improvement, time_avg_improvement, and the test's n, lags, mean, se, t, p).

    Raw improvements are of the pool's mean losses, in percent for squared errors; time averages, in percent for them too, are
    of differences first averaged over assets at each time.
    """
    detail = settled(detail)
    means = detail.join(pools, "asset").groupBy("pool", "horizon").agg(F.count("*").alias("n_origins"), *[F.avg(c).alias(c) for c in ("baseline_mse", "augmented_mse", "baseline_qlike", "augmented_qlike")])
    raw = F.inline(F.array(*[F.struct(F.lit(k).alias("loss"), x.alias("raw_improvement")) for k, x in (("mse", 100 * ratio(F.col("baseline_mse") - F.col("augmented_mse"), F.col("baseline_mse"))), ("qlike", F.col("baseline_qlike") - F.col("augmented_qlike")))]))
    tests = pooled_tests(detail, pools, lags).withColumn("time_avg_improvement", F.col("mean") * F.when(F.col("loss") == "mse", 100).otherwise(1))
    return means.select("pool", "horizon", "n_origins", raw).join(tests, ["pool", "horizon", "loss"])


def pivot_mean(df: DataFrame, rows: str, columns: str, value: str, names: list[str]) -> DataFrame:
    return df.groupBy(rows).pivot(columns, names).agg(F.avg(value))


def first_passage(paths: DataFrame, level: float, dt: float, by=()) -> DataFrame:
    """(by..., n_paths, mean_tau, se, censor_rate): the first step with |price| at the level or beyond, else the last step."""
    each = paths.groupBy(*by, "path_id").agg(F.min(F.when(F.abs("price") >= level, F.col("step"))).alias("_hit"), F.max("step").alias("_last"))
    tau = F.coalesce("_hit", "_last") * dt
    return each.groupBy(*by).agg(F.count("*").alias("n_paths"), F.avg(tau).alias("mean_tau"), (F.stddev_samp(tau) / F.sqrt(F.count("*"))).alias("se"), F.avg(F.col("_hit").isNull().cast("double")).alias("censor_rate"))


def threshold_volatility(paths: DataFrame, thresholds: list[float], dt: float, sigma: float, sigma_effective: float) -> DataFrame:
    """(threshold, n_obs, sigma_hat, abs errors) of price steps that begin with a signal at the threshold or above; thresholds never met give none."""
    steps = paths.select("signal", (F.lead("price").over(Window.partitionBy("path_id").orderBy("step")) - F.col("price")).alias("dp")).where("dp is not null")
    met = steps.select("dp", F.explode(F.filter(F.array(*map(F.lit, thresholds)), lambda t: F.col("signal") >= t)).alias("threshold"))
    hat = F.sqrt(F.sum(F.col("dp") * F.col("dp")) / (F.count("*") * dt))
    return met.groupBy("threshold").agg(F.count("*").alias("n_obs"), hat.alias("sigma_hat")).withColumns({"abs_error_sigma": F.abs(F.col("sigma_hat") - sigma), "abs_error_effective": F.abs(F.col("sigma_hat") - sigma_effective)})


def histogram(df: DataFrame, value: str, bins: int = 200) -> DataFrame:
    """(bin, n, density) of equal-width bins from the least to the greatest value; empty bins give no row."""
    rows = df.where(F.col(value).isNotNull())
    span = rows.agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("total"))
    width = (F.col("high") - F.col("low")) / bins
    place = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col(value) - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1))).otherwise(0)
    return rows.crossJoin(F.broadcast(span)).groupBy(place.alias("bin"), "total", "low", "high").agg(F.count("*").alias("n")).select("bin", "n", (F.col("n") / (F.col("total") * F.nullif(width, F.lit(0.0)))).alias("density"))


def path_scores(paths: DataFrame, zeta: float = 1.0) -> DataFrame:
    """(path_id, n_above, max_signal, score): steps with a signal above zeta, plus ten times the greatest signal."""
    each = paths.groupBy("path_id").agg(F.count_if(F.col("signal") > zeta).alias("n_above"), F.max("signal").alias("max_signal"))
    return each.withColumn("score", F.col("n_above") + 10 * F.col("max_signal"))


def best_path(paths: DataFrame, zeta: float, gamma: float, least_above: int) -> DataFrame:
    """The rows of the eligible path with the best score; the least path_id wins ties."""
    best = path_scores(paths, zeta).where((F.col("n_above") > least_above) & (F.col("max_signal") > gamma)).orderBy(F.desc("score"), "path_id").limit(1)
    return paths.join(F.broadcast(best.select("path_id")), "path_id", "left_semi")


def running_means(df: DataFrame, value: str, checkpoints: list[int], order=("step",), by=("path_id",)) -> DataFrame:
    """(by..., checkpoint, running_mean) over the first rows of a series."""
    w = Window.partitionBy(*by).orderBy(*order)
    rows = df.select(*by, F.row_number().over(w).alias("checkpoint"), F.avg(value).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("running_mean"))
    return rows.where(F.col("checkpoint").isin(checkpoints))


def episode(signal: DataFrame, half: int, value: str = "Z") -> DataFrame:
    """The rows around each asset's greatest value, the earliest of equals."""
    rows = settled(numbered(signal))
    peaks = rows.where(F.col(value).isNotNull()).groupBy("asset").agg(F.max_by("rn", F.struct(value, -F.col("rn"))).alias("_peak"))
    return rows.join(peaks, "asset").where(F.col("rn").between(F.col("_peak") - half, F.col("_peak") + half)).withColumn("offset", F.col("rn") - F.col("_peak")).drop("_peak", "rn")


def moving_average(df: DataFrame, value: str, window: int, by=("path_id",), rows: int = 100_000) -> DataFrame:
    """(by..., step, average) of the last `window` rows of series of steps 0, 1, ...; full windows only.

    Averages are taken within chunks of steps, each with the window before it, so no task has a whole series.
    """
    by = list(by)
    chunks = F.sequence(F.floor(F.col("step") / rows), F.floor((F.col("step") + window) / rows))
    spread = df.select(*by, "step", F.col(value).alias("x"), F.explode(chunks).alias("chunk"))
    order = Window.partitionBy(*by, "chunk").orderBy("step")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    summed = spread.withColumns({"total": F.sum("x").over(so_far), "count": F.count("x").over(so_far)})
    before = lambda c: F.coalesce(F.lag(c, window).over(order), F.lit(0))
    averaged = summed.withColumn("average", F.when(F.col("count") - before("count") == window, (F.col("total") - before("total")) / window))
    return averaged.where((F.floor(F.col("step") / rows) == F.col("chunk")) & F.col("average").isNotNull()).select(*by, "step", "average")


def quarter_means(averaged: DataFrame, by=("path_id",)) -> DataFrame:
    """(by..., first, last): means of the first and of the last quarter of the steps of a moving average."""
    by = list(by)
    n = averaged.groupBy(*by).agg(F.count("*").alias("n"), F.min("step").alias("low"))
    place = F.col("step") - F.col("low")
    mean = lambda yes: F.avg(F.when(yes, F.col("average")))
    return averaged.join(n, by).groupBy(*by).agg(mean(place < F.floor(F.col("n") / 4)).alias("first"), mean(place >= F.floor(F.col("n") * 3 / 4)).alias("last"))
