"""Features of bars: returns, the activation signal, realized variances, support and resistance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwise.functions.rolling import BY, current_z, framed, rolling_sum, series, shifted_z, with_extremes, with_long_sums, with_shifted_z
from barwise.functions.scalars import pooled
from barwise.operators.chunks import with_last

#: Sums over frames of more rows, and scores over frames of more rows, go by blocks.
LONG, LONG_SCORE = 300, 64


def with_returns(bars: DataFrame, by=BY) -> DataFrame:
    """Adds log_close, ret, abs_ret and log_volume; a negative volume counts as none."""
    return (
        bars.withColumn("log_close", F.ln("close"))
        .withColumn("ret", F.col("log_close") - F.lag("log_close").over(series(by)))
        .withColumns({"abs_ret": F.abs("ret"), "log_volume": F.log1p(F.when(F.col("volume").isNotNull(), F.greatest("volume", F.lit(0.0))))})
    )


def with_scores(returns: DataFrame, window: int, by=BY, tag: str = "") -> DataFrame:
    """Adds zV and zR, their names followed by `tag`: log volume and absolute return against the `window` rows before."""
    wanted = {f"zV{tag}": "log_volume", f"zR{tag}": "abs_ret"}
    if window > LONG_SCORE:
        return with_shifted_z(returns, wanted, window, by)
    return returns.withColumns({name: shifted_z(x, window, by) for name, x in wanted.items()})


def with_activation(returns: DataFrame, window: int = 288, smoothing: int = 3, pooling: str = "max", by=BY) -> DataFrame:
    """Adds zV, zR, Z_raw and Z; a row's scores use only the `window` rows before it."""
    scored = with_scores(returns, window, by)
    return scored.withColumn("Z_raw", pooled("zV", "zR", pooling)).withColumn("Z", framed(F.avg, "Z_raw", 1 - smoothing, 0, by))


def with_activations(returns: DataFrame, settings: list[tuple[int, int, str]], by=BY) -> DataFrame:
    """Adds, for each (window, smoothing, pooling), the column Z_<window>_<smoothing>_<pooling>; scores are shared between settings."""
    scored = returns
    for window in dict.fromkeys(w for w, _, _ in settings):
        scored = with_scores(scored, window, by, f"_{window}")
    raw = {f"_raw_{w}_{p}": pooled(f"zV_{w}", f"zR_{w}", p) for w, _, p in settings}
    smooth = {f"Z_{w}_{s}_{p}": framed(F.avg, f"_raw_{w}_{p}", 1 - s, 0, by) for w, s, p in settings}
    return scored.withColumns(raw).withColumns(smooth).drop(*raw, *[f"z{x}_{w}" for w, _, _ in settings for x in "VR"])


def with_display_signal(returns: DataFrame, window: int = 288, by=BY) -> DataFrame:
    """Adds Z_display, which looks at the current row, and the variance of the next `window` rows."""
    r2 = F.col("ret") * F.col("ret")
    scored = returns.withColumn("_r2", r2).withColumns({"_v": current_z("log_volume", window, by), "_r": current_z("abs_ret", window, by), "rv_forward": framed(F.sum, "_r2", 1, window, by)})
    return scored.withColumn("_m", pooled("_v", "_r")).withColumn("Z_display", framed(F.avg, "_m", -2, 0, by)).drop("_v", "_r", "_m", "_r2")


def with_realized_variance(returns: DataFrame, horizons: tuple[int, ...], by=BY) -> DataFrame:
    """Adds rv_past_h and rv_future_h: squared returns summed over the last h rows and the next h rows."""
    squared = returns.withColumn("_r2", F.col("ret") * F.col("ret"))
    short = [h for h in horizons if h <= LONG]
    out = squared.withColumns({f"rv_past_{h}": rolling_sum("_r2", h, by) for h in short} | {f"rv_future_{h}": framed(F.sum, "_r2", 1, h, by) for h in short})
    if rest := [h for h in horizons if h > LONG]:
        out = with_long_sums(out, {f"rv_past_{h}": ("_r2", h) for h in rest}, by)
        out = out.withColumns({f"rv_future_{h}": F.lead(f"rv_past_{h}", h).over(series(by)) for h in rest})
    return out.drop("_r2")


def with_har(returns: DataFrame, windows: dict[str, int], by=BY) -> DataFrame:
    """Adds rv_past_<name> for the named frames (such as day, week and month), of any length."""
    squared = returns.withColumn("_r2", F.col("ret") * F.col("ret"))
    out = squared.withColumns({f"rv_past_{k}": rolling_sum("_r2", n, by) for k, n in windows.items() if n <= LONG})
    rest = {f"rv_past_{k}": ("_r2", n) for k, n in windows.items() if n > LONG}
    return (with_long_sums(out, rest, by) if rest else out).drop("_r2")


def with_semivariance(returns: DataFrame, windows: dict[str, int], by=BY) -> DataFrame:
    """Adds rsv_neg_, rsv_pos_ and rq_past_<name>: squares of falls, of rises, and fourth powers times n / 3.

    A missing return counts as no fall and no rise, so the first frame is full one row before that of rq.
    """
    r2 = F.col("ret") * F.col("ret")
    parts = returns.withColumns({"_neg": F.when(F.col("ret") < 0, r2).otherwise(0.0), "_pos": F.when(F.col("ret") >= 0, r2).otherwise(0.0), "_r4": r2 * r2})
    sums = {f"{out}_past_{k}": rolling_sum(x, n, by) * (n / 3 if out == "rq" else 1) for k, n in windows.items() for out, x in (("rsv_neg", "_neg"), ("rsv_pos", "_pos"), ("rq", "_r4")) if n <= LONG}
    out = parts.withColumns(sums)
    long = {f"{o}_past_{k}": (x, n) for k, n in windows.items() for o, x in (("rsv_neg", "_neg"), ("rsv_pos", "_pos"), ("rq", "_r4")) if n > LONG}
    if long:
        out = with_long_sums(out, long, by).withColumns({f"rq_past_{k}": F.col(f"rq_past_{k}") * (n / 3) for k, n in windows.items() if n > LONG})
    return out.drop("_neg", "_pos", "_r4")


def with_quiet_extrema(signal: DataFrame, zeta: float = 1.0, window: int = 288, by=BY) -> DataFrame:
    """Adds quiet_high and quiet_low: extremes of quiet log prices (Z below zeta) in the last `window` rows; null where there are none."""
    quiet = signal.withColumn("_quiet", F.when(F.col("Z") < zeta, F.col("log_close")))
    return with_extremes(quiet, {"quiet_high": ("_quiet", "max"), "quiet_low": ("_quiet", "min")}, window, by).drop("_quiet")


def latched(quiet: DataFrame, by=BY) -> DataFrame:
    """Adds resistance and support: quiet_high and quiet_low, held on where there are none."""
    return with_last(quiet, {"resistance": "quiet_high", "support": "quiet_low"}, by=by).drop("quiet_high", "quiet_low")


def with_latched_extrema(signal: DataFrame, zeta: float = 1.0, window: int = 288, by=BY) -> DataFrame:
    """Adds resistance and support: extremes of quiet log prices in the last `window` rows, held on where there are none."""
    return latched(with_quiet_extrema(signal, zeta, window, by), by)


def event_features(events: DataFrame, history: int = 90, least: int | None = None, by=(), order=("funding_time", "event_id")) -> DataFrame:
    """Adds basis points, their change by event, and both z-scores against the events before."""
    least = max(20, history // 4) if least is None else least
    bps = events.withColumn("rate_bps", F.col("last_funding_rate") * 10_000)
    more = bps.withColumns({"abs_rate_bps": F.abs("rate_bps"), "rate_change_bps": F.col("rate_bps") - F.lag("rate_bps").over(series(by, order))})
    return more.withColumns({"abs_rate_z": shifted_z("abs_rate_bps", history, by, order, least), "rate_change_z": shifted_z("rate_change_bps", history, by, order, least)})
