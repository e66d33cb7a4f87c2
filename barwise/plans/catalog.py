"""One query per operator over the harness tables, each with the DuckDB SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwise.functions import scalars as S
from barwise.operators import asof, chunks, features, forecasting, inference, recursion, resampling, settle, splits, summaries
from barwise.plans import experiments, streams
from barwise.sources import harness

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

HORIZONS, FRAMES, WINDOW = (1, 5, 10, 22), {"d": 5, "w": 22, "m": 66}, 22
HOUR_WINDOW = 24


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many decimals, as sums in another order differ in their last digits."""
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


# ---- the derived tables, in Spark and in SQL ----

def day_returns(spark: SparkSession, d: str) -> DataFrame:
    return chunks.in_chunks(harness.day_bars(spark, d), features.with_returns, back=1)


def day_variance(spark: SparkSession, d: str, horizons: tuple[int, ...]) -> DataFrame:
    framed = lambda bars, by: features.with_realized_variance(features.with_returns(bars, by), horizons, by)
    return chunks.in_chunks(harness.day_bars(spark, d), framed, back=max(horizons) + 1, ahead=max(horizons))


def day_signal(spark: SparkSession, d: str) -> DataFrame:
    signal = lambda bars, by: features.with_activation(features.with_returns(bars, by), WINDOW, by=by)
    return chunks.in_chunks(harness.day_bars(spark, d), signal, back=WINDOW + 4)


def day_signal_variance(spark: SparkSession, d: str, horizons: tuple[int, ...]) -> DataFrame:
    made = lambda bars, by: features.with_realized_variance(features.with_activation(features.with_returns(bars, by), WINDOW, by=by), horizons, by)
    return chunks.in_chunks(harness.day_bars(spark, d), made, back=max(WINDOW + 4, *horizons) + 1, ahead=max(horizons))


def hour_signal(spark: SparkSession, d: str, smoothing: int = 3, pooling: str = "max") -> DataFrame:
    signal = lambda bars, by: features.with_activation(features.with_returns(bars, by), HOUR_WINDOW, smoothing, pooling, by)
    return chunks.in_chunks(harness.hour_bars(spark, d), signal, back=HOUR_WINDOW + smoothing + 1)


def day_frame(spark: SparkSession, d: str) -> DataFrame:
    """Bars with signal, variances of all horizons and frames, semivariances and quarticities."""

    def framed(bars, by):
        rows = features.with_realized_variance(features.with_activation(features.with_returns(bars, by), WINDOW, by=by), HORIZONS, by)
        return features.with_semivariance(features.with_har(rows, FRAMES, by), FRAMES, by)

    return chunks.in_chunks(harness.day_bars(spark, d), framed, back=max(WINDOW + 4, *HORIZONS, *FRAMES.values()) + 1, ahead=max(HORIZONS))


DAY = """day as (select l_returnflag as asset, l_shipdate as ts, sum(l_extendedprice) / sum(l_quantity) as close,
 max(l_extendedprice / l_quantity) as high, min(l_extendedprice / l_quantity) as low, sum(l_quantity) as volume from lineitem group by 1, 2)"""
HOUR = """hour as (select event_type as asset, date_trunc('hour', ts)::timestamp as ts, arg_min(1 + value, row(ts, event_id)) as open, max(1 + value) as high,
 min(1 + value) as low, arg_max(1 + value, row(ts, event_id)) as close, count(*)::double as volume from events group by 1, 2)"""


def returns_sql(source: str) -> str:
    return f"""ret0 as (select *, ln(close) as log_close, ln(1 + greatest(volume, 0)) as log_volume from {source}),
 ret as (select *, log_close - lag(log_close) over w as ret, abs(log_close - lag(log_close) over w) as abs_ret from ret0 window w as (partition by asset order by ts))"""


def signal_sql(source: str, window: int, smoothing: int = 3, pooling: str = "greatest(zV, zR)") -> str:
    z = lambda x: f"case when count({x}) over f = {window} then ({x} - avg({x}) over f) / nullif(stddev_pop({x}) over f, 0) end"
    return f"""{returns_sql(source)},
 sc as (select *, {z("log_volume")} as zV, {z("abs_ret")} as zR from ret window f as (partition by asset order by ts rows between {window} preceding and 1 preceding)),
 po as (select *, case when zV is not null and zR is not null then {pooling} end as Z_raw from sc),
 sig as (select *, case when count(Z_raw) over s = {smoothing} then avg(Z_raw) over s end as Z from po window s as (partition by asset order by ts rows between {smoothing - 1} preceding and current row))"""


def frame_sql() -> str:
    full = lambda x, a, b, n: f"case when count({x}) over (partition by asset order by ts rows between {a} and {b}) = {n} then sum({x}) over (partition by asset order by ts rows between {a} and {b}) end"
    rv = [f"{full('r2', f'{h - 1} preceding', 'current row', h)} as rv_past_{h}, {full('r2', '1 following', f'{h} following', h)} as rv_future_{h}" for h in HORIZONS]
    har = [f"{full('r2', f'{n - 1} preceding', 'current row', n)} as rv_past_{k}" for k, n in FRAMES.items()]
    return f"{DAY}, {signal_sql('day', WINDOW)}, sq as (select *, ret * ret as r2 from sig), fr as (select *, {', '.join(rv + har)} from sq)"


SPLIT_SQL = "case " + " ".join(f"when ts between timestamp '{a}' and timestamp '{b}' then '{k}'" for k, a, b in splits.DAY_SPLITS) + " end"

SPLIT_HOURS = "case " + " ".join(f"when ts between timestamp '{a}' and timestamp '{b}' then '{k}'" for k, a, b in splits.HOUR_SPLITS) + " end"


# ---- scans, projections, windows ----

@query(f"with {DAY}, {HOUR} select 'day' as kind, asset, ts, round(close, 6) as close, volume from day union all select 'hour', asset, ts, round(close, 6), volume from hour")
def bars_clean(spark: SparkSession, d: str) -> DataFrame:
    both = [bars.select(F.lit(kind).alias("kind"), "asset", "ts", "close", "volume") for kind, bars in (("day", harness.day_bars(spark, d)), ("hour", harness.hour_bars(spark, d)))]
    return rounded(both[0].unionByName(both[1]))


@query(f"with {DAY}, {returns_sql('day')} select asset, ts, round(log_close, 6) as log_close, round(ret, 6) as ret, round(abs_ret, 6) as abs_ret, round(log_volume, 6) as log_volume from ret")
def log_returns(spark: SparkSession, d: str) -> DataFrame:
    return rounded(day_returns(spark, d).select("asset", "ts", "log_close", "ret", "abs_ret", "log_volume"))


@query(f"with {HOUR}, {signal_sql('hour', HOUR_WINDOW)} select asset, ts, round(zV, 6) as zV, round(zR, 6) as zR, round(Z, 6) as Z from sig")
def activation_signal(spark: SparkSession, d: str) -> DataFrame:
    return rounded(hour_signal(spark, d).select("asset", "ts", "zV", "zR", "Z"))


@query(" union all ".join(f"(with {HOUR}, {signal_sql('hour', HOUR_WINDOW, s, p)} select asset, ts, {s} as smoothing, '{k}' as pooling, round(Z, 6) as Z from sig)" for s in (1, 3) for k, p in (("max", "greatest(zV, zR)"), ("mean", "(zV + zR) / 2"), ("sum", "zV + zR"))))
def activation_custom(spark: SparkSession, d: str) -> DataFrame:
    parts = [hour_signal(spark, d, smoothing=s, pooling=p).select("asset", "ts", F.lit(s).alias("smoothing"), F.lit(p).alias("pooling"), "Z") for s in (1, 3) for p in ("max", "mean", "sum")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return rounded(out)


@query(f"with {frame_sql()} select asset, ts, {', '.join(f'round(rv_past_{h}, 9) as rv_past_{h}, round(rv_future_{h}, 9) as rv_future_{h}' for h in HORIZONS)} from fr")
def realized_variance(spark: SparkSession, d: str) -> DataFrame:
    rows = day_variance(spark, d, HORIZONS)
    return rounded(rows.select("asset", "ts", *[f"rv_{k}_{h}" for h in HORIZONS for k in ("past", "future")]), 9)


@query(f"with {frame_sql()} select asset, ts, {', '.join(f'round(rv_past_{k}, 9) as rv_past_{k}' for k in FRAMES)} from fr")
def har_features(spark: SparkSession, d: str) -> DataFrame:
    framed = lambda bars, by: features.with_har(features.with_returns(bars, by), FRAMES, by)
    return rounded(chunks.in_chunks(harness.day_bars(spark, d), framed, back=max(FRAMES.values()) + 1).select("asset", "ts", *[f"rv_past_{k}" for k in FRAMES]), 9)


def _semi_sql() -> str:
    w = lambda n: f"over (partition by asset order by ts rows between {n - 1} preceding and current row)"
    x = {"rsv_neg": "case when ret < 0 then ret * ret else 0 end", "rsv_pos": "case when ret >= 0 then ret * ret else 0 end", "rq": "ret * ret * ret * ret"}
    picks = [f"round(case when count({x[o]}) {w(n)} = {n} then sum({x[o]}) {w(n)}{f' * {n} / 3' if o == 'rq' else ''} end, 9) as {o}_past_{k}" for k, n in FRAMES.items() for o in x]
    return f"with {DAY}, {returns_sql('day')} select asset, ts, {', '.join(picks)} from ret"


@query(_semi_sql())
def semivariance_quarticity(spark: SparkSession, d: str) -> DataFrame:
    framed = lambda bars, by: features.with_semivariance(features.with_returns(bars, by), FRAMES, by)
    return rounded(chunks.in_chunks(harness.day_bars(spark, d), framed, back=max(FRAMES.values()) + 1).select("asset", "ts", *[f"{o}_past_{k}" for k in FRAMES for o in ("rsv_neg", "rsv_pos", "rq")]), 9)


@query(f"""with {DAY}, {signal_sql('day', WINDOW)}, qu as (select *, case when Z < 1 then log_close end as q from sig),
 re as (select *, max(q) over f as r, min(q) over f as s from qu window f as (partition by asset order by ts rows between {WINDOW - 1} preceding and current row))
 select asset, ts, round(last_value(r ignore nulls) over u, 6) as resistance, round(last_value(s ignore nulls) over u, 6) as support from re window u as (partition by asset order by ts rows unbounded preceding)""")
def latched_extrema(spark: SparkSession, d: str) -> DataFrame:
    quiet = lambda bars, by: features.with_quiet_extrema(features.with_activation(features.with_returns(bars, by), WINDOW, by=by), 1.0, WINDOW, by)
    rows = chunks.in_chunks(harness.day_bars(spark, d), quiet, back=2 * WINDOW + 4)
    return rounded(features.latched(rows).select("asset", "ts", "resistance", "support"))


def _display_sql() -> str:
    z = lambda x: f"case when count({x}) over f = {WINDOW} then ({x} - avg({x}) over f) / greatest(stddev_pop({x}) over f, 1e-12) end"
    return f"""with {DAY}, {returns_sql('day')}, a as (select *, {z('log_volume')} as v, {z('abs_ret')} as r, case when count(ret) over g = {WINDOW} then sum(ret * ret) over g end as rv_forward from ret
 window f as (partition by asset order by ts rows between {WINDOW - 1} preceding and current row), g as (partition by asset order by ts rows between 1 following and {WINDOW} following)),
 b as (select *, case when v is not null and r is not null then greatest(v, r) end as m from a)
 select asset, ts, round(case when count(m) over h = 3 then avg(m) over h end, 6) as Z_display, round(rv_forward, 6) as rv_forward from b window h as (partition by asset order by ts rows between 2 preceding and current row)"""


@query(_display_sql())
def display_signal(spark: SparkSession, d: str) -> DataFrame:
    framed = lambda bars, by: features.with_display_signal(features.with_returns(bars, by), WINDOW, by)
    return rounded(chunks.in_chunks(harness.day_bars(spark, d), framed, back=WINDOW + 4, ahead=WINDOW).select("asset", "ts", "Z_display", "rv_forward"))


# ---- events and as-of joins ----

RATES = "ev as (select ts as funding_time, event_id, (value - 50) / 1e4 as last_funding_rate from events where event_type = 'error')"


def _event_sql() -> str:
    z = lambda x: f"case when count({x}) over f >= 22 then ({x} - avg({x}) over f) / nullif(stddev_pop({x}) over f, 0) end"
    return f"""{RATES}, ev1 as (select *, last_funding_rate * 10000 as rate_bps from ev), ev2 as (select *, abs(rate_bps) as abs_rate_bps, rate_bps - lag(rate_bps) over (order by funding_time, event_id) as rate_change_bps from ev1),
 evf as (select *, {z('abs_rate_bps')} as abs_rate_z, {z('rate_change_bps')} as rate_change_z from ev2 window f as (order by funding_time, event_id rows between 90 preceding and 1 preceding))"""


@query(f"with {_event_sql()} select event_id, funding_time, round(rate_bps, 6) as rate_bps, round(rate_change_bps, 6) as rate_change_bps, round(abs_rate_z, 6) as abs_rate_z, round(rate_change_z, 6) as rate_change_z from evf")
def event_features(spark: SparkSession, d: str) -> DataFrame:
    # the events have no asset: all are one series, as the contract of this table says
    return rounded(features.event_features(harness.rate_events(spark, d)).select("event_id", "funding_time", "rate_bps", "rate_change_bps", "abs_rate_z", "rate_change_z"))


@query(f"""with {HOUR}, {RATES}, k as (select funding_time, max(event_id) as event_id from ev group by 1), l as (select ev.* from ev join k using (funding_time, event_id))
 select asset, ts, round(close, 6) as close, funding_time, round(last_funding_rate, 9) as last_funding_rate from (select * from hour where asset <> 'error') asof left join l on ts >= funding_time""")
def asof_backward(spark: SparkSession, d: str) -> DataFrame:
    bars = harness.hour_bars(spark, d).where("asset <> 'error'").select("asset", "ts", F.round("close", 6).alias("close"))
    events = harness.rate_events(spark, d)
    joined = asof.asof_backward(bars, events, "ts", "funding_time", ["funding_time", "last_funding_rate"], ties=["funding_time", "event_id"])
    return joined.withColumn("last_funding_rate", F.round("last_funding_rate", 9))


@query(f"""with {HOUR}, {RATES}, b as (select asset, ts, (epoch_us(ts) - epoch_us(funding_time)) / 6e7 as before from (select * from hour where asset <> 'error') asof left join ev on ts >= funding_time),
 g as (select asset, ts, before, (epoch_us(funding_time) - epoch_us(ts)) / 6e7 as after from b asof left join ev on ts <= funding_time)
 select asset, ts, round(case when least(before, after) <= 10 then least(before, after) end, 4) as minutes_to_event, coalesce(least(before, after) <= 10, false) as in_window from g""")
def asof_nearest_tolerance(spark: SparkSession, d: str) -> DataFrame:
    bars = harness.hour_bars(spark, d).where("asset <> 'error'").select("asset", "ts")
    near = asof.gap_to_nearest(bars, harness.rate_events(spark, d), "ts", "funding_time", "minutes_to_event", 10)
    return rounded(near.withColumn("in_window", F.col("minutes_to_event").isNotNull()), 4)


SCHEDULE = "least(m, 1440 - m, abs(m - 480), abs(m - 960)) <= 60"


@query(f"""with {HOUR}, {signal_sql('hour', HOUR_WINDOW)}, fl as (select *, {SCHEDULE} as in_window from (select *, hour(ts) * 60 + minute(ts) as m from sig))
 select asset, in_window, count(*) as n, round(avg(Z), 6) as mean_z from fl where Z is not null group by 1, 2""")
def scheduled_window(spark: SparkSession, d: str) -> DataFrame:
    rows = hour_signal(spark, d).where("Z is not null").withColumn("in_window", S.minutes_to_schedule("ts") <= 60)
    return rounded(rows.groupBy("asset", "in_window").agg(F.count("*").alias("n"), F.avg("Z").alias("mean_z")))


@query(f"""with {HOUR}, {signal_sql('hour', HOUR_WINDOW)}, fl as (select *, {SCHEDULE} as w from (select *, hour(ts) * 60 + minute(ts) as m from sig) where Z is not null)
 select asset, count(*) as n, round(avg(Z), 6) as mean_z, round(avg(case when w then Z end), 6) as mean_z_inside, round(avg(case when not w then Z end), 6) as mean_z_outside, round(avg(w::int), 6) as share_inside,
 round(corr(Z, w::int), 6) as corr_flag, round(corr(Z, log_volume), 6) as corr_other from fl group by 1""")
def activation_by_window(spark: SparkSession, d: str) -> DataFrame:
    rows = hour_signal(spark, d).withColumn("w", S.minutes_to_schedule("ts") <= 60)
    return rounded(summaries.activation_summary(rows, "w", "log_volume"))


@query(f"""with {HOUR}, {signal_sql('hour', HOUR_WINDOW)}, fl as (select *, {SCHEDULE} as w from (select *, hour(ts) * 60 + minute(ts) as m from sig) where Z is not null),
 g as (select asset, count(*) filter (w) as n1, count(*) filter (not w) as n2, avg(Z) filter (w) as m1, avg(Z) filter (not w) as m2, var_samp(Z) filter (w) as v1, var_samp(Z) filter (not w) as v2, corr(Z, w::int) as r from fl group by 1)
 select asset, n1 as n_inside, n2 as n_outside, round(m1, 6) as mean_inside, round(m2, 6) as mean_outside, round(m1 - m2, 6) as diff, round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / greatest(1, n1 + n2 - 2)), 6) as cohen_d,
 round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) as welch_t, round(pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)), 4) as welch_df, round(r, 6) as corr from g""")
def window_effect_size(spark: SparkSession, d: str) -> DataFrame:
    rows = hour_signal(spark, d).withColumn("w", S.minutes_to_schedule("ts") <= 60)
    out = summaries.effect_size(rows, "Z", "w").withColumn("welch_df", F.round("welch_df", 4))
    return rounded(out.drop("welch_p"))  # window_effect_p has it: SQL knows no Student tail


@query()
def window_effect_p(spark: SparkSession, d: str) -> DataFrame:
    rows = hour_signal(spark, d).withColumn("w", S.minutes_to_schedule("ts") <= 60)
    return summaries.effect_size(rows, "Z", "w").select("asset", F.round("welch_t", 6).alias("welch_t"), F.round("welch_df", 4).alias("welch_df"), F.round("welch_p", 5).alias("welch_p"))


# ---- splits, origins, summaries ----

@query(f"with {DAY} select {SPLIT_SQL} as split, asset, count(*) as n from day group by 1, 2")
def split_counts(spark: SparkSession, d: str) -> DataFrame:
    return splits.with_split(harness.day_bars(spark, d)).groupBy("split", "asset").agg(F.count("*").alias("n"))


@query(f"""with {frame_sql()}, t as (select *, row_number() over (partition by asset order by ts) as rn from fr where {SPLIT_SQL} = 'test' and Z is not null and rv_future_5 > 0 and rv_past_m is not null)
 select asset, ts, round(rv_future_5, 9) as rv_future from t where (rn - 1) % 5 = 0""")
def nonoverlap_origins(spark: SparkSession, d: str) -> DataFrame:
    rows = splits.complete(splits.in_split(day_frame(spark, d), "test"), ["Z", "rv_future_5", "rv_past_m"], ["rv_future_5"])
    return rounded(splits.nonoverlapping(rows, 5).select("asset", "ts", F.col("rv_future_5").alias("rv_future")), 9)


@query(f"""with {DAY}, {signal_sql('day', WINDOW)}, b as (select asset, quantile_cont(Z, 0.01) as lo, quantile_cont(Z, 0.99) as hi from sig where {SPLIT_SQL} = 'train' group by 1)
 select asset, ts, round(least(greatest(Z, lo), hi), 6) as Z from sig join b using (asset) where Z is not null""")
def winsorize(spark: SparkSession, d: str) -> DataFrame:
    rows = day_signal(spark, d).select("asset", "ts", "Z").where("Z is not null")
    return rounded(splits.winsorized(rows, splits.clip_bounds(splits.in_split(rows, "train"), "Z", 0.01, 0.99), "Z"))


@query(f"""with {HOUR}, g as (select *, (epoch_us(ts) - epoch_us(lag(ts) over (partition by asset order by ts))) / 3.6e9 as gap from hour)
 select asset, min(ts) as start, max(ts) as "end", count(*) as n_rows, coalesce(sum(case when gap > 1 then gap - 1 end), 0)::bigint as missing_bars, count(*) filter (volume = 0) as zero_volume_bars,
 {', '.join(f"count(*) filter (ts between timestamp '{a}' and timestamp '{b}') as {k}_rows" for k, a, b in splits.HOUR_SPLITS)} from g group by 1""")
def data_coverage(spark: SparkSession, d: str) -> DataFrame:
    return summaries.coverage(harness.hour_bars(spark, d), splits.HOUR_SPLITS, 3600)


def _central(x: str, by: str, source: str) -> str:
    return f"""m0 as (select *, {x} - avg({x}) over (partition by {by}) as c from {source} where {x} is not null),
 mo as (select {by}, count(*) as n, avg({x}) as mean, sqrt(avg(c * c)) as std, avg(c * c * c) / pow(avg(c * c), 1.5) as skewness, avg(c * c * c * c) / pow(avg(c * c), 2) as kurtosis from m0 group by {by})"""


@query(f"with {DAY}, {returns_sql('day')}, sp as (select *, {SPLIT_SQL} as split from ret), {_central('ret', 'asset, split', 'sp')} select asset, split, n, round(mean, 6) as mean, round(std, 6) as std, round(skewness, 6) as skewness, round(kurtosis, 6) as kurtosis from mo")
def return_moments(spark: SparkSession, d: str) -> DataFrame:
    return rounded(summaries.moment_table(splits.with_split(day_returns(spark, d)), "ret", ("asset", "split")))


@query(f"""with {DAY}, n as (select asset, l.ts::date as day, sum(close * volume) as notional, count(*) as bars from day l where year(ts) = 1999 group by 1, 2),
 e as (select asset, avg(notional) as mean_notional, median(notional) as median_notional, sum(notional) as total_notional, count(*) as n_days, sum(bars)::bigint as n_bars from n group by 1), r as (select *, row_number() over (order by mean_notional desc, asset)::int as rank from e)
 select asset, round(mean_notional, 2) as mean_notional, round(median_notional, 2) as median_notional, round(total_notional, 2) as total_notional, n_days, n_bars, rank, rank <= 2 as top_two from r""")
def liquidity_rank(spark: SparkSession, d: str) -> DataFrame:
    return rounded(summaries.liquidity(harness.day_bars(spark, d), 1999), 2)


@query(f"with {frame_sql()}, s as (select *, coalesce({SPLIT_SQL}, 'none') as split from fr) select split, round(avg(rv_past_5) filter (asset = 'A'), 9) as \"A\", round(avg(rv_past_5) filter (asset = 'N'), 9) as \"N\", round(avg(rv_past_5) filter (asset = 'R'), 9) as \"R\" from s group by 1")
def pivot_metric(spark: SparkSession, d: str) -> DataFrame:
    rows = splits.with_split(day_variance(spark, d, (5,))).fillna({"split": "none"})
    return rounded(summaries.pivot_mean(rows, "split", "asset", "rv_past_5", ["A", "N", "R"]), 9)


@query(f"""with {DAY}, {signal_sql('day', WINDOW)}, n as (select *, row_number() over (partition by asset order by ts) as rn from sig), p as (select asset, arg_max(rn, row(Z, -rn)) as peak from n where Z is not null group by 1)
 select asset, ts, round(Z, 6) as Z, (rn - peak)::int as "offset" from n join p using (asset) where rn between peak - 30 and peak + 30""")
def activation_episode(spark: SparkSession, d: str) -> DataFrame:
    return rounded(summaries.episode(day_signal(spark, d), 30).select("asset", "ts", "Z", F.col("offset").cast("int").alias("offset")))


# ---- dependence ----

PAIRS = f"pz as (select *, {SPLIT_SQL} as split from sig where Z is not null), pr as (select asset, split, ts, Z as x, lead(Z) over (partition by asset, split order by ts) as y from pz)"


@query(f"""with {DAY}, {signal_sql('day', WINDOW)}, {PAIRS}, f as (select asset, count(*) as n, regr_slope(y, x) as b, regr_intercept(y, x) as a, regr_r2(y, x) as r2, var_pop(y) as v from pr where split = 'train' and y is not null group by 1),
 k as (select *, case when b > 0 and b < 1 then -ln(b) end as kappa from f)
 select asset, n, round(b, 6) as slope, round(a, 6) as intercept, round(r2, 6) as r2, round(kappa, 6) as kappa, round(a / (1 - b), 6) as level, round(sqrt(v * (1 - r2) * 2 * kappa / (1 - b * b)), 6) as sigma, round(24 * ln(2) / kappa, 6) as half_life_hours from k""")
def ou_fit(spark: SparkSession, d: str) -> DataFrame:
    return rounded(inference.first_order_fit(splits.in_split(day_signal(spark, d), "train"), "Z", 1.0))


@query(f"""with {DAY}, {signal_sql('day', WINDOW)}, {PAIRS}, f as (select asset, regr_slope(y, x) as b, regr_intercept(y, x) as a from pr where split = 'train' and y is not null group by 1), q as (select *, a + b * x as f from pr join f using (asset) where y is not null)
 select asset, split, count(*) as n, round(1 - sum((y - f) * (y - f)) / (var_pop(y) * count(*)), 6) as r2_oos, round(sqrt(avg((y - f) * (y - f))), 6) as rmse, round(corr(y, f), 6) as corr from q group by 1, 2""")
def ou_oos(spark: SparkSession, d: str) -> DataFrame:
    rows = splits.with_split(day_signal(spark, d))
    return rounded(inference.first_order_check(rows, inference.first_order_fit(rows.where("split = 'train'"), "Z", 1.0), "Z", ("asset", "split")))


ACF = f"""{DAY}, {signal_sql('day', WINDOW)}, {PAIRS}, az as (select asset, split, row_number() over (partition by asset, split order by ts) as rn, Z - avg(Z) over (partition by asset, split) as c from pz where split is not null),
 ac as (select a.asset, a.split, (b.rn - a.rn)::int as lag, sum(a.c * b.c) as s from az a join az b on a.asset = b.asset and a.split = b.split and b.rn between a.rn and a.rn + 300 group by 1, 2, 3),
 af as (select x.asset, x.split, x.lag, x.s / y.s as acf from ac x join ac y on x.asset = y.asset and x.split = y.split and y.lag = 0 where x.lag > 0),
 fi as (select asset, regr_slope(y, x) as b from pr where split = 'train' and y is not null group by 1),
 er as (select asset, split, lag, acf, pow(b, lag) as implied_acf, abs(acf - pow(b, lag)) as abs_error, pow(acf - pow(b, lag), 2) as squared_error from af join fi using (asset))"""


def _acf(spark: SparkSession, d: str) -> DataFrame:
    rows = settle.settled(splits.with_split(day_signal(spark, d)).where("split is not null and Z is not null"))
    fits = inference.first_order_fit(rows.where("split = 'train'"), "Z", 1.0)
    return inference.acf_errors(inference.autocorrelations(rows, "Z", 300, ("asset", "split")), fits, ("asset", "split"))


@query(f"with {ACF} select asset, split, lag, round(acf, 6) as acf, round(implied_acf, 6) as implied_acf, round(abs_error, 6) as abs_error, round(squared_error, 6) as squared_error from er")
def acf_lags(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_acf(spark, d))


@query(f"with {ACF} select asset, split, max(lag) as max_lag, round(avg(abs_error), 6) as acf_mae, round(sqrt(avg(squared_error)), 6) as acf_rmse, round(max(abs_error), 6) as acf_max_abs_error from er group by 1, 2")
def acf_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(inference.acf_summary(_acf(spark, d), ("asset", "split")))


@query(f"""with {DAY}, {returns_sql('day')}, o as (select *, row_number() over (partition by asset order by ts) - 1 as rn, count(*) over (partition by asset) as n from ret where ret is not null), b as (select asset, rn // (n // 20) as b, ret, n from o where rn // (n // 20) < 20),
 c as (select asset, b, ret, ret - avg(ret) over (partition by asset, b) as c from b), e as (select asset, b, avg(ret) as mean, sqrt(avg(c * c)) as std, avg(c * c * c) / pow(avg(c * c), 1.5) as skewness, avg(c * c * c * c) / pow(avg(c * c), 2) as kurtosis from c group by 1, 2),
 l as (unpivot e on mean, std, skewness, kurtosis into name statistic value x) select asset, statistic, round(avg(x), 6) as estimate, round(stddev_samp(x) / sqrt(count(*)), 6) as batch_se, count(*) as batches from l group by 1, 2""")
def batch_means_se(spark: SparkSession, d: str) -> DataFrame:
    return rounded(inference.batch_means(day_returns(spark, d), "ret", 20))


def _nw_sql(source: str, x: str, by: str) -> str:
    return f"""nw0 as (select {by}, {x} - avg({x}) over (partition by {by}) as c, {x} as x, row_number() over (partition by {by} order by ts) as rn, count(*) over (partition by {by}) as n from {source} where {x} is not null),
 nw1 as (select {', '.join('a.' + k.strip() for k in by.split(','))}, b.rn - a.rn as lag, sum(a.c * b.c) as s from nw0 a join nw0 b on {' and '.join(f'a.{k.strip()} = b.{k.strip()}' for k in by.split(','))} and b.rn between a.rn and a.rn + floor(sqrt(a.n)) group by all),
 nw2 as (select {by}, count(*) as n, avg(x) as mean, least(floor(sqrt(count(*))), count(*) - 1)::int as lags from nw0 group by {by}),
 nw3 as (select {by}, n, lags, mean, sqrt(greatest(sum(case when lag = 0 then s else 2 * (1 - lag / (lags + 1)) * s end) / n / n, 0)) as se from nw1 join nw2 using ({by}) where lag <= lags group by {by}, n, lags, mean)"""


@query(f"with {DAY}, {returns_sql('day')}, {_nw_sql('ret', 'ret', 'asset')} select asset, n, lags, round(mean, 9) as mean, round(se, 9) as se, round(mean / se, 6) as t from nw3")
def nw_mean_test(spark: SparkSession, d: str) -> DataFrame:
    out = inference.newey_west(day_returns(spark, d), "ret").drop("p")
    return out.withColumns({"mean": F.round("mean", 9), "se": F.round("se", 9), "t": F.round("t", 6)})


@query()
def nw_mean_p(spark: SparkSession, d: str) -> DataFrame:
    out = inference.newey_west(day_returns(spark, d), "ret", law="normal")
    return out.select("asset", "n", "lags", F.round("mean", 9).alias("mean"), F.round("t", 6).alias("t"), F.round("p", 5).alias("p"))


@query(f"""with {frame_sql()}, h as (select asset, Z, rv_future_5 as y, row_number() over (partition by asset order by ts) as rn from fr where {SPLIT_SQL} = 'test' and Z is not null and rv_future_5 is not null),
 f as (select asset, count(*) as n, regr_intercept(y, Z) as a, regr_slope(y, Z) as b, regr_r2(y, Z) as r2, sum(Z) as sx, sum(Z * Z) as sxx from h group by 1),
 u as (select asset, rn, y - a - b * Z as u0, (y - a - b * Z) * Z as u1 from h join f using (asset)),
 g as (select i.asset, (case when j.rn = i.rn then 1 else 2 end) * (1 - (j.rn - i.rn) / 11) as w, i.u0 * j.u0 as g00, i.u1 * j.u1 as g11, (i.u0 * j.u1 + i.u1 * j.u0) / 2 as g01 from u i join u j on i.asset = j.asset and j.rn between i.rn and i.rn + 10),
 s as (select asset, sum(w * g00) as s00, sum(w * g01) as s01, sum(w * g11) as s11 from g group by 1), v as (select *, n * sxx - sx * sx as det from f join s using (asset))
 select asset, n, round(a, 6) as intercept, round(b, 6) as coef_z, round(a * det / sqrt(sxx * sxx * s00 - 2 * sxx * sx * s01 + sx * sx * s11), 4) as t_intercept, round(b * det / sqrt(sx * sx * s00 - 2 * n * sx * s01 + n * n * s11), 4) as t_z, round(r2, 6) as r2 from v""")
def hac_regression_one(spark: SparkSession, d: str) -> DataFrame:
    rows = settle.settled(splits.in_split(day_signal_variance(spark, d, (5,)), "test"))
    out = inference.hac_regression(rows, "rv_future_5", ["Z"], 10)
    t = lambda k: F.round(F.col("t_hac")[k], 4)
    return rounded(out.select("asset", "n", F.col("coef")[0].alias("intercept"), F.col("coef")[1].alias("coef_z"), t(0).alias("t_intercept"), t(1).alias("t_z"), "r2"))


#: Two tails of the normal and of Student's law by Simpson's rule, as SQL has no such functions.
_STEPS = 2_000


def _simpson(density: str, upto: str) -> str:
    """The integral of `density`, written in @, from 0 to `upto`."""
    weight = f"case when i = 0 or i = {_STEPS} then 1 when i % 2 = 1 then 4 else 2 end"
    at = density.replace("@", f"({upto} * i / {_STEPS})")
    return f"({upto} / {_STEPS} / 3 * list_sum(list_transform(range({_STEPS} + 1), lambda i: ({weight}) * ({at}))))"


def _normal_p(t: str) -> str:
    return f"(1 - 2 * {_simpson('exp(-@ * @ / 2)', f'least(abs({t}), 12)')} / sqrt(2 * pi()))"


def _student_p(t: str, df: str) -> str:
    return f"(1 - 2 * {_simpson(f'pow(1 + @ * @ / {df}, -({df} + 1) / 2)', f'abs({t})')} * exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt({df} * pi()))"


def _hac_sql() -> str:
    """Least squares on Z and the past variance by the closed inverse of a 3 x 3 matrix, and Bartlett sums of the scores."""
    long = " union all ".join(f"select asset, split, ts, {h} as horizon, {max(1, 2 * h)} as lags, Z as a, rv_past_{h} as b, rv_future_{h} as y from hs" for h in HORIZONS)
    keys, u = "asset, split, horizon", ("e", "e * a", "e * b")
    same = " and ".join(f"i.{k} = j.{k}" for k in keys.split(", "))
    sums = ", ".join(f"sum(w * (i.u{p} * j.u{q} + i.u{q} * j.u{p}) / 2) as m{p}{q}" for p in range(3) for q in range(p, 3))
    c = lambda p, q: f"c{min(p, q)}{max(p, q)}"
    m = lambda p, q: f"m{min(p, q)}{max(p, q)}"
    se = [" + ".join(f"{c(k, p)} * {m(p, q)} * {c(q, k)}" for p in range(3) for q in range(3)) for k in range(3)]
    return f"""{frame_sql()}, hs as (select *, {SPLIT_SQL} as split from fr), hl as (select * from ({long}) where split is not null and split <> 'recent' and a is not null and b is not null and y is not null),
 h1 as (select *, row_number() over (partition by {keys} order by ts) as rn from hl),
 h2 as (select {keys}, any_value(lags) as lags, count(*)::double as n, sum(a) as sa, sum(b) as sb, sum(a * a) as saa, sum(a * b) as sab, sum(b * b) as sbb, sum(y) as sy, sum(a * y) as say, sum(b * y) as sby, var_pop(y) * count(*) as tss from h1 group by {keys}),
 h3 as (select *, n * (saa * sbb - sab * sab) - sa * (sa * sbb - sab * sb) + sb * (sa * sab - saa * sb) as det from h2),
 h4 as (select *, (saa * sbb - sab * sab) / det as c00, (sab * sb - sa * sbb) / det as c01, (sa * sab - saa * sb) / det as c02, (n * sbb - sb * sb) / det as c11, (sa * sb - n * sab) / det as c12, (n * saa - sa * sa) / det as c22 from h3),
 h5 as (select *, c00 * sy + c01 * say + c02 * sby as b0, c01 * sy + c11 * say + c12 * sby as b1, c02 * sy + c12 * say + c22 * sby as b2 from h4),
 h6 as (select h1.*, {', '.join(f'{x} as u{k}' for k, x in enumerate(u))} from (select h1.*, y - b0 - b1 * a - b2 * b as e from h1 join h5 using ({keys})) h1),
 h7 as (select {', '.join(f'i.{k}' for k in keys.split(', '))}, sum(case when i.rn = j.rn then i.e * i.e else 0 end) as sse, {sums.replace('sum(w', 'sum(case when i.rn = j.rn then 1 else 2 * (1 - (j.rn - i.rn) / (i.lags + 1)) end')} from h6 i join h6 j on {same} and j.rn between i.rn and i.rn + i.lags group by all),
 h8 as (select *, sqrt({se[0]}) as s0, sqrt({se[1]}) as s1, sqrt({se[2]}) as s2 from h5 join h7 using ({keys}))
 select {keys}, n::bigint as n, round(b0, 6) as coef_intercept, round(b1, 6) as coef_z, round(b2, 4) as coef_past, round(b1 / s1, 3) as t_z, round(b2 / s2, 3) as t_past, round({_normal_p('b1 / s1')}, 4) as p_z, round({_normal_p('b2 / s2')}, 4) as p_past, round(1 - sse / tss, 6) as r2 from h8"""


@query(f"with {_hac_sql()}")
def hac_regression(spark: SparkSession, d: str) -> DataFrame:
    """Both regressors, their HAC statistics and normal p, for every horizon and split, the horizon being a key with its own lags."""
    frame = splits.with_split(day_signal_variance(spark, d, HORIZONS)).where("split is not null and split <> 'recent'")
    each = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit(max(1, 2 * h)).alias("lags"), F.col(f"rv_past_{h}").alias("past"), F.col(f"rv_future_{h}").alias("y")) for h in HORIZONS])
    rows = settle.settled(frame.select("asset", "split", "ts", "Z", F.inline(each)))
    out = inference.hac_regression(rows, "y", ["Z", "past"], "lags", ("asset", "split", "horizon", "lags"))
    at = lambda c, k, digits: F.round(F.col(c)[k], digits)
    return out.select(
        "asset", "split", "horizon", "n", at("coef", 0, 6).alias("coef_intercept"), at("coef", 1, 6).alias("coef_z"), at("coef", 2, 4).alias("coef_past"),
        at("t_hac", 1, 3).alias("t_z"), at("t_hac", 2, 3).alias("t_past"), at("p_hac", 1, 4).alias("p_z"), at("p_hac", 2, 4).alias("p_past"), F.round("r2", 6).alias("r2"),
    )


ORACLE_SQL["nw_mean_p"] = f"""with {DAY}, {returns_sql('day')}, {_nw_sql('ret', 'ret', 'asset')}, np as (select *, {_normal_p('mean / se')} as two from nw3)
 select asset, n, lags, round(mean, 9) as mean, round(mean / se, 6) as t, round(case when mean > 0 then two / 2 else 1 - two / 2 end, 5) as p from np"""
ORACLE_SQL["window_effect_p"] = f"""with {HOUR}, {signal_sql('hour', HOUR_WINDOW)}, fl as (select *, {SCHEDULE} as w from (select *, hour(ts) * 60 + minute(ts) as m from sig) where Z is not null),
 g as (select asset, count(*) filter (w) as n1, count(*) filter (not w) as n2, avg(Z) filter (w) as m1, avg(Z) filter (not w) as m2, var_samp(Z) filter (w) as v1, var_samp(Z) filter (not w) as v2 from fl group by 1),
 k as (select asset, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) as t, pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) as nu from g)
 select asset, round(t, 6) as welch_t, round(nu, 4) as welch_df, round({_student_p('t', 'nu')}, 5) as welch_p from k"""


# ---- forecasts, with one regressor where SQL is to follow ----

def simple_detail(spark: SparkSession, d: str, known=("train", "validation"), asked: str = "test") -> DataFrame:
    """Origins 5 rows apart in a range: forecasts from the variance of the last 5 rows, and of the last 22."""
    rows = splits.complete(day_frame(spark, d), ["Z", "rv_past_d", "rv_past_w", "rv_future_5"], ["rv_future_5"]).select("asset", "ts", "Z", "rv_past_d", "rv_past_w", F.col("rv_future_5").alias("rv_future"))
    rows = settle.settled(rows)
    train, test = splits.in_split(rows, known), splits.nonoverlapping(splits.in_split(rows, asked), 5)
    both = forecasting.forecast(train, test, "rv_future", ["rv_past_d"], ridge=0.0, name="baseline_forecast")
    both = forecasting.forecast(train, both, "rv_future", ["rv_past_w"], ridge=0.0, name="augmented_forecast")
    return forecasting.with_losses(both, "rv_future", "baseline_forecast", "augmented_forecast").withColumns({"horizon": F.lit(5), "family": F.lit("HAR")})


def detail_sql() -> str:
    fit = lambda k: f"f{k} as (select *, exp(a + b * ln(greatest(rv_past_{k}, 1e-12))) as raw from (select asset, regr_slope(ln(greatest(rv_future, 1e-12)), ln(greatest(rv_past_{k}, 1e-12))) as b, regr_intercept(ln(greatest(rv_future, 1e-12)), ln(greatest(rv_past_{k}, 1e-12))) as a from mf where split in ('train', 'validation') group by 1) join mf using (asset)), s{k} as (select asset, avg(greatest(rv_future, 1e-12) / raw) as smear from f{k} where split in ('train', 'validation') group by 1), g{k} as (select asset, ts, greatest(raw * smear, 1e-12) as f{k} from f{k} join s{k} using (asset) where split = 'test')"
    return f"""{frame_sql()}, mf as (select asset, ts, Z, rv_past_d, rv_past_w, rv_future_5 as rv_future, {SPLIT_SQL} as split from fr where Z is not null and rv_past_d is not null and rv_past_w is not null and rv_future_5 > 0),
 {fit('d')}, {fit('w')}, te as (select *, row_number() over (partition by asset order by ts) as rn from mf where split = 'test'),
 dt as (select asset, 5 as horizon, 'HAR' as family, ts, Z, rv_future, fd as bf, fw as af, pow(rv_future - fd, 2) as bm, pow(rv_future - fw, 2) as am, rv_future / fd - ln(rv_future / fd) - 1 as bq, rv_future / fw - ln(rv_future / fw) - 1 as aq from te join gd using (asset, ts) join gw using (asset, ts) where (rn - 1) % 5 = 0)"""


@query(f"with {detail_sql()} select asset, ts, round(rv_future, 9) as rv_future, round(bf, 9) as baseline_forecast, round(af, 9) as augmented_forecast, round(bm - am, 9) as mse_diff, round(bq - aq, 6) as qlike_diff, round(pow(rv_future - bf, 2) - (pow(rv_future - af, 2) - pow(bf - af, 2)), 9) as cw from dt")
def forecast_losses(spark: SparkSession, d: str) -> DataFrame:
    out = simple_detail(spark, d).select("asset", "ts", "rv_future", "baseline_forecast", "augmented_forecast", "mse_diff", F.round("qlike_diff", 6).alias("qlike_diff"), "cw")
    return rounded(out, 9)


@query(f"with {detail_sql()}, di as (select asset, ts, bq - aq as x from dt), {_nw_sql('di', 'x', 'asset')} select asset, n, lags, round(mean, 6) as mean, round(mean / se, 6) as t from nw3")
def dm_test(spark: SparkSession, d: str) -> DataFrame:
    return rounded(inference.newey_west(simple_detail(spark, d), "qlike_diff").select("asset", "n", "lags", "mean", "t"))


@query(f"""with {detail_sql()}, pools(pool, asset) as (values ('all', 'A'), ('all', 'N'), ('all', 'R'), ('AN', 'A'), ('AN', 'N')), no as (select asset, ts, 'mse' as loss, (bm - am) / avg(bm) over (partition by asset) as x from dt union all select asset, ts, 'qlike', bq - aq from dt),
 di as (select pool, loss, ts, avg(x) as x from no join pools using (asset) group by 1, 2, 3), {_nw_sql('di', 'x', 'pool, loss')}, ra as (select pool, count(*) as n_origins, 100 * (avg(bm) - avg(am)) / avg(bm) as mse, avg(bq) - avg(aq) as qlike from dt join pools using (asset) group by 1)
 select pool, loss, n_origins, round(case loss when 'mse' then mse else qlike end, 6) as raw_improvement, round(mean * case loss when 'mse' then 100 else 1 end, 6) as time_avg_improvement, n, lags, round(mean, 6) as mean, round(mean / se, 6) as t from nw3 join ra using (pool)""")
def pooled_losses(spark: SparkSession, d: str) -> DataFrame:
    pools = spark.createDataFrame([("all", "A"), ("all", "N"), ("all", "R"), ("AN", "A"), ("AN", "N")], "pool string, asset string")
    return rounded(summaries.pooled_table(simple_detail(spark, d), pools).select("pool", "loss", "n_origins", "raw_improvement", "time_avg_improvement", "n", "lags", "mean", "t"))


@query(f"""with {detail_sql()}, lo as (select asset, 'baseline' as model, rv_future as y, bf as f from dt union all select asset, 'augmented', rv_future, af from dt), cu as (select *, quantile_cont(y, 0.9) over w as cy, quantile_cont(f, 0.9) over w as cf from lo window w as (partition by asset, model))
 select asset, model, count(*) as n, round(avg(case when f >= cf then y end) / avg(y), 6) as top_over_all, round(count(*) filter (f >= cf and y >= cy) / count(*) filter (y >= cy), 6) as recall, round(avg(greatest(y / f - 1, 0)), 6) as mean_under,
 round(avg(case when y >= cy then greatest(y / f - 1, 0) end), 6) as tail_under from cu group by 1, 2""")
def high_vol_ranking(spark: SparkSession, d: str) -> DataFrame:
    return rounded(summaries.high_ranking(simple_detail(spark, d), by=("asset",)))


@query(f"""with {frame_sql()}, m as (select asset, {SPLIT_SQL} as split, rv_future_5 as y, rv_past_5 as f from fr where rv_future_5 > 0 and rv_past_5 is not null), k as (select asset, 0.01::double as alpha, quantile_cont(y / greatest(f, 1e-12), 0.99) as k from m where split = 'validation' group by 1 union all select asset, 0.05, quantile_cont(y / greatest(f, 1e-12), 0.95) from m where split = 'validation' group by 1)
 select asset, alpha, 'naive' as model, round(k, 6) as multiplier, round(avg((y > k * f)::int), 6) as exceedance, round(avg(k * f), 6) as mean_margin, round(median(k * f), 6) as median_margin, count(*) as n from m join k using (asset) where split = 'test' group by asset, alpha, k""")
def margin_calibration(spark: SparkSession, d: str) -> DataFrame:
    rows = splits.complete(day_frame(spark, d), ["rv_past_5", "rv_future_5"], ["rv_future_5"]).withColumn("rv_future", F.col("rv_future_5"))
    out = forecasting.margins(splits.in_split(rows, "validation"), splits.in_split(rows, "test"), {"naive": F.col("rv_past_5")})
    return rounded(out)


@query(f"""with {detail_sql()} select asset, Z >= 0 as active, count(*) as n, round(avg(Z), 6) as mean_z, round(avg(rv_future), 6) as mean_future_rv, round(avg(bm - am), 6) as mean_mse_diff, round(avg(bq - aq), 6) as mean_qlike_diff, round(1 - avg(am) / avg(bm), 6) as mse_improvement from dt group by 1, 2""")
def window_losses(spark: SparkSession, d: str) -> DataFrame:
    return rounded(summaries.flag_means(simple_detail(spark, d).withColumn("active", F.col("Z") >= 0), ["asset"], "active"))


def _margin_sql() -> str:
    models = "select asset, split, rv_future as y, {k} as f, '{m}' as model from mg"
    long = " union all ".join(models.format(k=k, m=m) for m, k in (("baseline", "bf"), ("augmented", "af")))
    fit = lambda k: f"v{k} as (select mf.*, exp(a + b * ln(greatest(rv_past_{k}, 1e-12))) as raw from mf join (select asset, regr_slope(ln(greatest(rv_future, 1e-12)), ln(greatest(rv_past_{k}, 1e-12))) as b, regr_intercept(ln(greatest(rv_future, 1e-12)), ln(greatest(rv_past_{k}, 1e-12))) as a from mf where split = 'train' group by 1) using (asset)), w{k} as (select asset, avg(greatest(rv_future, 1e-12) / raw) as smear from v{k} where split = 'train' group by 1), x{k} as (select asset, ts, greatest(raw * smear, 1e-12) as f{k} from v{k} join w{k} using (asset) where split = 'validation')"
    return f"""with {detail_sql()}, {fit('d')}, {fit('w')}, tv as (select *, row_number() over (partition by asset order by ts) as rn from mf where split = 'validation'),
 mg as (select asset, 'validation' as split, rv_future, fd as bf, fw as af from tv join xd using (asset, ts) join xw using (asset, ts) where (rn - 1) % 5 = 0 union all select asset, 'test', rv_future, bf, af from dt), ml as ({long}),
 mu as ({" union all ".join(f"select asset, model, {x}::double as alpha, quantile_cont(y / greatest(f, 1e-12), {1 - x}) as k from ml where split = 'validation' group by all" for x in (0.05, 0.1))}),
 ms as (select asset, model, alpha, k as multiplier, avg((y > k * f)::int) as exceedance, avg(k * f) as mean_margin, median(k * f) as median_margin, avg(k * f) / avg(y) as margin_over_rv, count(*) as n from ml join mu using (asset, model) where split = 'test' group by all),
 al as (select asset, alpha, model, multiplier, exceedance, 1 - exceedance as coverage, mean_margin, median_margin, margin_over_rv, null::double as reduction_pct, n from ms
  union all select a.asset, a.alpha, 'augmented vs baseline', null, a.exceedance - b.exceedance, b.exceedance - a.exceedance, a.mean_margin - b.mean_margin, a.median_margin - b.median_margin, a.margin_over_rv - b.margin_over_rv, 100 * (b.mean_margin - a.mean_margin) / b.mean_margin, b.n from ms a join ms b on a.asset = b.asset and a.alpha = b.alpha and a.model = 'augmented' and b.model = 'baseline')
 select asset, alpha, model, {', '.join(f'round({c}, 6) as {c}' for c in ('multiplier', 'exceedance', 'coverage', 'mean_margin', 'median_margin', 'margin_over_rv', 'reduction_pct'))}, n from al"""


@query(_margin_sql())
def margin_efficiency(spark: SparkSession, d: str) -> DataFrame:
    """Margins of the two one-regressor models at matched validation coverage, and what the second one saves."""
    out = forecasting.margin_table(simple_detail(spark, d, ("train",), "validation"), simple_detail(spark, d), by=("asset",))
    return rounded(out)


@query(f"""with {HOUR}, {signal_sql('hour', HOUR_WINDOW)}, {_event_sql()}, k as (select funding_time, max(event_id) as event_id from evf group by 1), l as (select evf.* from evf join k using (funding_time, event_id)),
 te as (select asset, ts, Z from sig where asset <> 'error' and Z is not null and {SPLIT_HOURS} = 'test'), be as (select te.*, (epoch_us(ts) - epoch_us(funding_time)) / 6e7 as before, abs_rate_z from te asof left join l on ts >= funding_time),
 g as (select be.asset, be.ts, Z, before, be.abs_rate_z, (epoch_us(l.funding_time) - epoch_us(ts)) / 6e7 as after from be asof left join l on ts <= l.funding_time), fl as (select *, coalesce(least(before, after) <= 10, false) as w from g),
 h as (select asset, count(*) filter (w) as n1, count(*) filter (not w) as n2, avg(Z) filter (w) as m1, avg(Z) filter (not w) as m2, var_samp(Z) filter (w) as v1, var_samp(Z) filter (not w) as v2, avg(Z) as m, corr(Z, abs_rate_z) as r from fl group by 1)
 select asset, n1 as n_inside, n2 as n_outside, round(m1, 6) as mean_inside, round(m2, 6) as mean_outside, round(m1 - m2, 6) as diff, round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / greatest(1, n1 + n2 - 2)), 6) as cohen_d, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) as welch_t, round(m, 6) as mean_all, round(r, 6) as corr_abs_rate_z from h""")
def rate_window_effect(spark: SparkSession, d: str) -> DataFrame:
    signal = settle.settled(hour_signal(spark, d).where("asset <> 'error'"))
    out = experiments.rate_window_effect(signal, harness.rate_events(spark, d), 10, ties=("funding_time", "event_id"), ranges=splits.HOUR_SPLITS)
    return rounded(out.drop("welch_df", "welch_p"))  # as window_effect_p has them


LCG = lambda r, b, seed: f"((((({r} * 1000003 + {b} * 7919 + {seed}) * 1103515245 + 12345) % 2147483648) * 1103515245 + 12345) % 2147483648)"


@query(f"""with {DAY}, {returns_sql('day')}, o as (select asset, row_number() over w as rn, sum(ret) over (partition by asset order by ts rows unbounded preceding) as total, ret from ret where ret is not null window w as (partition by asset order by ts)), z as (select asset, max(rn) as n, avg(ret) as mean from o group by 1),
 dr as (select asset, n, r, b, {LCG('r', 'b', 42)} % (n - 22 + 1) as start from z, (select unnest(range(200)) as r), (select unnest(range(200)) as b) where b < ceil(n / 22)), en as (select *, start + least(22, n - b * 22) as stop from dr),
 me as (select asset, r, sum(hi.total - coalesce(lo.total, 0)) / n as m from en join o hi on hi.asset = en.asset and hi.rn = stop left join o lo on lo.asset = en.asset and lo.rn = start group by en.asset, r, n)
 select asset, n, round(mean, 6) as mean, round(ci_low, 6) as ci_low, round(ci_high, 6) as ci_high, p_nonpositive from z join (select asset, quantile_cont(m, 0.025) as ci_low, quantile_cont(m, 0.975) as ci_high, avg((m <= 0)::int) as p_nonpositive from me group by 1) using (asset)""".replace("select asset, r, sum(hi", "select en.asset, r, sum(hi"))
def block_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return rounded(resampling.moving_block(day_returns(spark, d), "ret", 22, 200))


@query(f"""with {DAY}, {returns_sql('day')}, o as (select asset, datediff('day', min(ts) over (partition by asset), ts) // 7 as bin, ret - avg(ret) over (partition by asset) as c from (select * from ret where ret is not null)), bl as (select asset, bin, count(*)::double as s0, sum(c) as s1, sum(c * c) as s2, sum(c * c * c) as s3, sum(c * c * c * c) as s4, row_number() over (partition by asset order by bin) - 1 as pick, count(*) over (partition by asset) as blocks from o group by 1, 2),
 dr as (select asset, r, {LCG('r', 'b', 43)} % blocks as pick from (select distinct asset, blocks from bl), (select unnest(range(100)) as r), (select unnest(range(2000)) as b) where b < blocks), su as (select asset, r, sum(s1) / sum(s0) as m1, sum(s2) / sum(s0) as m2, sum(s3) / sum(s0) as m3, sum(s4) / sum(s0) as m4, any_value(blocks) as blocks from dr join bl using (asset, pick) group by 1, 2),
 st as (select asset, blocks, m1 as mean, sqrt(m2 - m1 * m1) as std, (m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1) / pow(m2 - m1 * m1, 1.5) as skewness, (m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * m1 * m1 * m1 * m1) / pow(m2 - m1 * m1, 2) as kurtosis from su)
 select asset, statistic, round(stddev_samp(x), 8) as boot_se, any_value(blocks) as blocks from (unpivot st on mean, std, skewness, kurtosis into name statistic value x) group by 1, 2""")
def calendar_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return rounded(resampling.calendar_block(day_returns(spark, d), "ret", 7, 100, 43), 8)


_LAG_ONE = "corr(x, before)"


@query(f"""with {DAY}, {returns_sql('day')}, o as (select asset, ts, datediff('day', min(ts) over (partition by asset), ts) // 7 as bin, ret as x from ret where ret is not null), bi as (select asset, bin, row_number() over (partition by asset order by bin) - 1 as pick, count(*) over (partition by asset) as blocks from (select distinct asset, bin from o)),
 dr as (select asset, r, b, {LCG('r', 'b', 43)} % blocks as pick from (select distinct asset, blocks from bi), (select unnest(range(40)) as r), (select unnest(range(2000)) as b) where b < blocks),
 sa as (select asset, r, x, lag(x) over (partition by asset, r order by b, ts) as before from dr join bi using (asset, pick) join o using (asset, bin)), es as (select asset, r, median(x) as median, {_LAG_ONE} as lag_one from sa group by 1, 2),
 wh as (select asset, median(x) as median, {_LAG_ONE} as lag_one from (select asset, x, lag(x) over (partition by asset order by ts) as before from o) group by 1)
 select asset, statistic, round(any_value(estimate), 6) as estimate, round(stddev_samp(x), 7) as boot_se, any_value(blocks) as blocks from (unpivot es on median, lag_one into name statistic value x) join (unpivot wh on median, lag_one into name statistic value estimate) using (asset, statistic) join (select distinct asset, blocks from bi) using (asset) group by 1, 2""")
def user_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Statistics given as functions, here the median and the correlation of neighbours, over drawn weeks."""
    chosen = {"median": resampling.median, "lag_one": resampling.lag_one}
    out = resampling.calendar_statistics(day_returns(spark, d), "ret", chosen, 7, 40, 43)
    return out.withColumns({"estimate": F.round("estimate", 6), "boot_se": F.round("boot_se", 7)})


@query(f"""with {DAY}, {returns_sql('day')}, o as (select *, row_number() over (partition by asset order by ts) - 1 as rn, count(*) over (partition by asset) as n from ret where ret is not null), b as (select asset, rn // (n // 20) as b, ts, ret as x from o where rn // (n // 20) < 20),
 c as (select *, lag(x) over (partition by asset, b order by ts) as before from b), e as (select asset, b, median(x) as median, {_LAG_ONE} as lag_one from c group by 1, 2)
 select asset, statistic, round(avg(x), 6) as estimate, round(stddev_samp(x) / sqrt(count(*)), 6) as batch_se, count(*) as batches from (unpivot e on median, lag_one into name statistic value x) group by 1, 2""")
def user_batch_statistics(spark: SparkSession, d: str) -> DataFrame:
    chosen = {"median": resampling.median, "lag_one": resampling.lag_one}
    return rounded(resampling.batch_statistics(day_returns(spark, d), "ret", chosen, 20))


def _batches_sql(k: int) -> str:
    return f"""bo as (select *, row_number() over (partition by asset, split order by ts) - 1 as rn, count(*) over (partition by asset, split) as n from sp), bb as (select *, rn // (n // {k}) as b from bo where rn // (n // {k}) < {k}), bc as (select *, ret - avg(ret) over (partition by asset, split, b) as c from bb),
 be as (select asset, split, b, avg(ret) as mean, sqrt(avg(c * c)) as std, avg(c * c * c) / pow(avg(c * c), 1.5) as skewness, avg(c * c * c * c) / pow(avg(c * c), 2) as kurtosis from bc group by 1, 2, 3),
 ba as (select asset, split, statistic, stddev_samp(x) / sqrt(count(*)) as batch_se, count(*) as batches from (unpivot be on mean, std, skewness, kurtosis into name statistic value x) group by 1, 2, 3)"""


def _blocks_sql(name: str, days: int, seed: int, replicates: int) -> str:
    k = name
    return f"""{k}0 as (select asset, split, datediff('day', min(ts) over (partition by asset, split), ts) // {days} as bin, ret - avg(ret) over (partition by asset, split) as c from sp),
 {k}1 as (select asset, split, bin, count(*)::double as s0, sum(c) as s1, sum(c * c) as s2, sum(c * c * c) as s3, sum(c * c * c * c) as s4, row_number() over (partition by asset, split order by bin) - 1 as pick, count(*) over (partition by asset, split) as blocks from {k}0 group by 1, 2, 3),
 {k}2 as (select asset, split, r, {LCG('r', 'b', seed)} % blocks as pick from (select distinct asset, split, blocks from {k}1), (select unnest(range({replicates})) as r), (select unnest(range(3000)) as b) where b < blocks),
 {k}3 as (select asset, split, r, sum(s1) / sum(s0) as m1, sum(s2) / sum(s0) as m2, sum(s3) / sum(s0) as m3, sum(s4) / sum(s0) as m4, any_value(blocks) as blocks from {k}2 join {k}1 using (asset, split, pick) group by 1, 2, 3),
 {k}4 as (select asset, split, blocks, m1 as mean, sqrt(m2 - m1 * m1) as std, (m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1) / pow(m2 - m1 * m1, 1.5) as skewness, (m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * m1 * m1 * m1 * m1) / pow(m2 - m1 * m1, 2) as kurtosis from {k}3),
 {k} as (select asset, split, statistic, stddev_samp(x) as {k}_se, any_value(blocks) as {k}_blocks from (unpivot {k}4 on mean, std, skewness, kurtosis into name statistic value x) group by 1, 2, 3)"""


@query(f"""with {DAY}, {returns_sql('day')}, sp as (select asset, split, ts, ret from (select *, {SPLIT_SQL} as split from ret) where split is not null and ret is not null), {_central('ret', 'asset, split', 'sp')}, {_batches_sql(100)}, {_blocks_sql('daily', 1, 42, 500)}, {_blocks_sql('weekly', 7, 43, 500)},
 va as (select asset, split, statistic, x as value from (unpivot mo on mean, std, skewness, kurtosis into name statistic value x))
 select asset, split, statistic, round(value, 6) as value, round(daily_se, 7) as daily_se, daily_blocks, round(weekly_se, 7) as weekly_se, weekly_blocks, round(batch_se, 7) as batch_se, batches from va left join daily using (asset, split, statistic) left join weekly using (asset, split, statistic) left join ba using (asset, split, statistic)""")
def real_moments(spark: SparkSession, d: str) -> DataFrame:
    out = experiments.real_moments(day_returns(spark, d))
    return out.withColumns({"value": F.round("value", 6), **{c: F.round(c, 7) for c in ("daily_se", "weekly_se", "batch_se")}})


# ---- sequential states and paths ----

def _leaky_sql(fast: float, slow: float) -> str:
    g = lambda p, x: f"(case when {p} > {x} then {{a}} else {{b}} end)"
    a, b = f"(1 - pow(2, -1.0 / {fast}))", f"(1 - pow(2, -1.0 / {slow}))"
    r, s = g("n.log_close", "p.r").format(a=a, b=b), f"(case when n.log_close < p.s then {a} else {b} end)"
    return f"""with recursive {HOUR}, {signal_sql('hour', HOUR_WINDOW)}, st as (select asset, ts, log_close, Z, row_number() over (partition by asset order by ts) as rn from sig where Z is not null),
 re as (select asset, ts, rn, log_close as r, log_close as s from st where rn = 1 union all select n.asset, n.ts, n.rn, case when n.Z < 1 then p.r + {r} * (n.log_close - p.r) else p.r end, case when n.Z < 1 then p.s + {s} * (n.log_close - p.s) else p.s end from re p join st n on n.asset = p.asset and n.rn = p.rn + 1)
 select asset, ts, round(r, 6) as leaky_resistance, round(s, 6) as leaky_support from re"""


@query(_leaky_sql(2, 24))
def leaky_extrema(spark: SparkSession, d: str) -> DataFrame:
    rows = hour_signal(spark, d).where("Z is not null")
    return rounded(recursion.leaky_extrema(rows, [(2, 24)]).drop("fast", "slow"))


#: The published grid of half-lives, the slow ones in hours as the bars are.
FAST, SLOW = (1, 3, 6, 12, 24), (6, 12, 24, 48, 84, 168)

LEAKY_GRID = f"""{HOUR}, {signal_sql('hour', HOUR_WINDOW)}, qu as (select *, case when Z < 1 then log_close end as q, {SPLIT_HOURS} as split from sig),
 ex as (select *, max(q) over f as r0, min(q) over f as s0 from qu window f as (partition by asset order by ts rows between {HOUR_WINDOW - 1} preceding and current row)),
 lt as (select asset, ts, split, log_close, Z, last_value(r0 ignore nulls) over u as resistance, last_value(s0 ignore nulls) over u as support from ex window u as (partition by asset order by ts rows unbounded preceding)),
 st as (select *, row_number() over (partition by asset order by ts) as rn from (select *, ts >= min(case when Z is not null and log_close is not null then ts end) over (partition by asset) as live from lt where split is not null) where live),
 se as (select fast, slow, 1 - pow(2, -1.0 / fast) as a, 1 - pow(2, -1.0 / slow) as b from (values {', '.join(f'({x}.0::double)' for x in FAST)}) f(fast), (values {', '.join(f'({x}.0::double)' for x in SLOW)}) s(slow) where slow > fast),
 re as (select asset, rn, fast, slow, a, b, log_close as r, log_close as s from st, se where rn = 1 union all
  select n.asset, n.rn, fast, slow, a, b, case when n.Z < 1 then p.r + (case when n.log_close > p.r then a else b end) * (n.log_close - p.r) else p.r end, case when n.Z < 1 then p.s + (case when n.log_close < p.s then a else b end) * (n.log_close - p.s) else p.s end from re p join st n on n.asset = p.asset and n.rn = p.rn + 1),
 er as (select asset, split, fast, slow, count(*) as n, avg(abs(resistance - r)) as mae_r, sqrt(avg(pow(resistance - r, 2))) as rmse_r, corr(resistance, r) as corr_r, avg(abs(support - s)) as mae_s, sqrt(avg(pow(support - s, 2))) as rmse_s, corr(support, s) as corr_s
  from st join re using (asset, rn) where resistance is not null and support is not null group by 1, 2, 3, 4)"""


def _calibrated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    def quiet(bars, by):
        return features.with_quiet_extrema(features.with_activation(features.with_returns(bars, by), HOUR_WINDOW, by=by), 1.0, HOUR_WINDOW, by)

    rows = features.latched(chunks.in_chunks(harness.hour_bars(spark, d), quiet, back=2 * HOUR_WINDOW + 4))
    latched = splits.with_split(rows, splits.HOUR_SPLITS).where("split is not null")
    return recursion.calibrate(latched.select("asset", "ts", "split", "log_close", "Z", "resistance", "support"), list(FAST), list(SLOW))


@query(f"with recursive {LEAKY_GRID} select asset, split, fast, slow, n, {', '.join(f'round({x}, 6) as {x}' for x in ('mae_r', 'rmse_r', 'corr_r', 'mae_s', 'rmse_s', 'corr_s'))}, round((mae_r + mae_s) / 2, 6) as mean_mae from er")
def leaky_grid(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_calibrated(spark, d)[0])


@query(f"with recursive {LEAKY_GRID}, va as (select *, (mae_r + mae_s) / 2 as mean_mae from er where split = 'validation') select asset, arg_min(fast, row(mean_mae, fast, slow)) as fast, arg_min(slow, row(mean_mae, fast, slow)) as slow, round(min(mean_mae), 6) as validation_mae from va group by 1")
def leaky_best(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_calibrated(spark, d)[1])


@query(f"""with recursive {LEAKY_GRID}, va as (select *, (mae_r + mae_s) / 2 as mean_mae from er where split = 'validation'), be as (select asset, arg_min(fast, row(mean_mae, fast, slow)) as fast, arg_min(slow, row(mean_mae, fast, slow)) as slow from va group by 1)
 select asset, split, fast, slow, n, {', '.join(f'round({x}, 6) as {x}' for x in ('mae_r', 'rmse_r', 'corr_r', 'mae_s', 'rmse_s', 'corr_s'))}, round((mae_r + mae_s) / 2, 6) as mean_mae from er join be using (asset, fast, slow)""")
def leaky_calibration(spark: SparkSession, d: str) -> DataFrame:
    """The errors, in every split, of the setting that validation chose."""
    grid, best = _calibrated(spark, d)
    return rounded(grid.join(best.select("asset", "fast", "slow"), ["asset", "fast", "slow"], "left_semi"))


PATHS = "pa as (select user_id as path_id, row_number() over (partition by user_id order by ts, event_id) - 1 as step, (value - 20) / 100 as price, value / 20 as signal from events)"


@query(f"""with {PATHS}, e as (select path_id, min(case when abs(price) >= 0.5 then step end) as h, max(step) as l from pa group by 1) select count(*) as n_paths, round(avg(coalesce(h, l) * 0.01), 6) as mean_tau, round(stddev_samp(coalesce(h, l) * 0.01) / sqrt(count(*)), 6) as se, round(avg((h is null)::int), 6) as censor_rate from e""")
def first_passage(spark: SparkSession, d: str) -> DataFrame:
    return rounded(summaries.first_passage(harness.user_paths(spark, d), 0.5, 0.01))


@query(f"""with {PATHS}, s as (select signal, lead(price) over (partition by path_id order by step) - price as dp from pa), t as (select threshold, count(*) as n_obs, sqrt(sum(dp * dp) / (count(*) * 0.01)) as h from s, (values (1.0::double), (2.0::double), (3.0::double)) v(threshold) where dp is not null and signal >= threshold group by 1)
 select threshold, n_obs, round(h, 6) as sigma_hat, round(abs(h - 0.5), 6) as abs_error_sigma, round(abs(h - 0.455), 6) as abs_error_effective from t""")
def threshold_vol(spark: SparkSession, d: str) -> DataFrame:
    return rounded(summaries.threshold_volatility(harness.user_paths(spark, d), [1.0, 2.0, 3.0], 0.01, 0.5, 0.455))


@query(f"""with {PATHS}, s as (select min(price) as lo, max(price) as hi, count(*) as n from pa) select least(floor((price - lo) / (hi - lo) * 200), 199)::bigint as bin, count(*) as n, round(count(*) / (any_value(s.n) * (any_value(hi) - any_value(lo)) / 200), 6) as density from pa, s group by 1""")
def histogram_density(spark: SparkSession, d: str) -> DataFrame:
    return rounded(summaries.histogram(harness.user_paths(spark, d), "price")).withColumn("bin", F.col("bin").cast("long"))


@query(f"with {PATHS} select path_id, count(*) filter (signal > 1) as n_above, round(max(signal), 6) as max_signal, round(count(*) filter (signal > 1) + 10 * max(signal), 6) as score from pa group by 1")
def path_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(summaries.path_scores(harness.user_paths(spark, d)))


@query(f"""with {PATHS}, sc as (select path_id, count(*) filter (signal > 1) as n_above, max(signal) as max_signal from pa group by 1), b as (select path_id from sc where n_above > 3 and max_signal > 1.2 order by n_above + 10 * max_signal desc, path_id limit 1)
 select path_id, step::int as step, round(price, 6) as price, round(signal, 6) as signal from pa join b using (path_id)""")
def best_path(spark: SparkSession, d: str) -> DataFrame:
    return rounded(summaries.best_path(harness.user_paths(spark, d), 1.0, 1.2, 3))


@query(f"""with {PATHS} select path_id, step::int as step, round(0.9 / (1 + exp(-10 * (signal - 1.5))), 6) as weight, round(1 + 2 * price * price + signal * signal + 4 * price * price + price * price / 4, 6) as energy,
 round(-log10(greatest(abs(price), 1e-12)), 6) as minus_log, case step when 12 then '1 hour' when 24 then '2 hours' else step || ' bars' end as label, case when count(*) over (partition by path_id) >= 20 then 1 end as kept from pa qualify kept = 1""")
def path_columns(spark: SparkSession, d: str) -> DataFrame:
    """Regime weight, energy, -log10 and label of each step of the paths with 20 steps or more."""
    p = F.col("price")
    rows = splits.gated(harness.user_paths(spark, d), ["path_id"], 20)
    made = {"weight": S.regime_weight("signal", 0.9, 10, 1.5), "energy": S.energy("price", "signal", 2 * p, p / 2, 2), "minus_log": S.minus_log10(F.abs("price")), "label": S.horizon_label("step", {12: "1 hour", 24: "2 hours"}), "kept": F.lit(1)}
    return rounded(rows.withColumns(made).select("path_id", "step", *made))


@query(f"with {PATHS}, r as (select path_id, step + 1 as checkpoint, avg(price) over (partition by path_id order by step rows unbounded preceding) as m from pa) select path_id, checkpoint::int as checkpoint, round(m, 6) as running_mean from r where checkpoint in (1, 3, 10, 30)")
def running_means(spark: SparkSession, d: str) -> DataFrame:
    return rounded(summaries.running_means(harness.user_paths(spark, d), "price", [1, 3, 10, 30]))


MOVING = f"{PATHS}, mv as (select path_id, step, avg(price) over w as m, count(*) over w as n from pa window w as (partition by path_id order by step rows between 4 preceding and current row))"


@query(f"with {MOVING} select path_id, step::int as step, round(m, 9) as average from mv where n = 5")
def moving_averages(spark: SparkSession, d: str) -> DataFrame:
    return rounded(summaries.moving_average(harness.user_paths(spark, d), "price", 5), 9)


@query(f"""with {MOVING}, mq as (select *, step - min(step) over (partition by path_id) as place, count(*) over (partition by path_id) as rows from mv where n = 5)
 select path_id, round(avg(m) filter (place < rows // 4), 9) as first, round(avg(m) filter (place >= floor(rows * 3 / 4)), 9) as last from mq group by 1""")
def moving_quarters(spark: SparkSession, d: str) -> DataFrame:
    return rounded(summaries.quarter_means(summaries.moving_average(harness.user_paths(spark, d), "price", 5)), 9)


# ---- streams ----

@query(f"with {HOUR} select asset, ts, round(open, 6) as open, round(high, 6) as high, round(low, 6) as low, round(close, 6) as close, volume from hour")
def streamed_bars(spark: SparkSession, d: str) -> DataFrame:
    """The hourly bars, built by a stream over the files of events."""
    return rounded(streams.hour_bars(spark, d))


@query(_leaky_sql(2, 24))
def streamed_levels(spark: SparkSession, d: str) -> DataFrame:
    """The rows of leaky_extrema from a stream over the signal, written by day and read a few files a batch."""
    levels = streams.leaky_levels(hour_signal(spark, d).where("Z is not null"), [(2, 24)])
    return rounded(levels.where("not late").select("asset", "ts", "leaky_resistance", "leaky_support"))


# ---- whole experiments ----

def _solved_sql(width: int, keys: str, p: str) -> str:
    """CTEs {p}so (keys, family, n_train, base, more, base_r2, more_r2) from model rows {p}tr (keys, family, n_base, y, x).

    Both models' normal equations are solved by elimination, a step of a recursion for each column. A column of zeros, and
    for the smaller model a column beyond its own, stands as a unit column and gets no coefficient.
    """
    g = lambda i, j: f"sum(x[{min(i, j)}] * x[{max(i, j)}])"
    span = range(1, width + 1)
    gram, rhs = f"[{', '.join('[' + ', '.join(g(i, j) for j in span) + ']' for i in span)}]", f"[{', '.join(f'sum(x[{i}] * y)' for i in span)}]"
    used = lambda i: f"({i} <= nb and g[{i}][{i}] > 0)"
    cell = f"case when {used('i')} and {used('j')} then g[i][j] + case when i = j and i > 1 then 1e-10 else 0 end when i = j then 1.0 else 0.0 end"
    row = f"list_append(list_transform(range(1, {width} + 1), lambda j: {cell}), case when {used('i')} then b[i] else 0.0 end)"
    step = "list_transform(m, lambda r, i: list_transform(r, lambda v, c: case when i = step + 1 then v / m[step + 1][step + 1] else v - r[step + 1] * m[step + 1][c] / m[step + 1][step + 1] end))"
    beta = f"list_transform(m, lambda r: r[{width} + 1])"
    r2 = lambda k: f"1 - (yy - 2 * list_inner_product({k}, b) + list_inner_product({k}, list_transform(g, lambda r: list_inner_product(r, {k})))) / (yy - b[1] * b[1] / n)"
    return f"""{p}su as (select {keys}, family, any_value(n_base) as n_base, count(*) as n, {gram} as g, {rhs} as b, sum(y * y) as yy from {p}tr group by {keys}, family having count(*) >= {{least}}),
 {p}el as (select {keys}, family, kind, 0 as step, list_transform(range(1, {width} + 1), lambda i: {row}) as m from (select *, n_base as nb, 'base' as kind from {p}su union all select *, {width}, 'more' from {p}su)
  union all select {keys}, family, kind, step + 1, {step} from {p}el where step < {width}),
 {p}be as (select {keys}, family, any_value({beta}) filter (kind = 'base') as base, any_value({beta}) filter (kind = 'more') as more from {p}el where step = {width} group by {keys}, family),
 {p}so as (select *, n as n_train, {r2('base')} as base_r2, {r2('more')} as more_r2 from {p}su join {p}be using ({keys}, family))"""


def nested_sql(source: str, models: list[forecasting.Nested], keys: str = "asset, horizon", p: str = "", train=("train", "validation"), test: str = "test", split: str = SPLIT_SQL, gates: tuple[int, int] = (100, 20), same: tuple[int, ...] = (), frames=tuple(FRAMES)) -> str:
    """CTEs ending in {p}de: the details of `models` over the long rows `source` (keys, ts, rv_h, past columns, Z and others, rv_future)."""
    width = max(m.width(frames) for m in models)
    log = lambda c: f"ln(greatest({c}, 1e-12))"
    parts = []
    for m in models:
        value = (lambda c: c) if m.spec == "level_floor" else log
        logged = ["rv_h", *[f"{kind}_past_{k}" for kind in ("rv", *forecasting.FAMILIES[m.family]) for k in frames]]
        own = f"case when horizon in ({', '.join(map(str, same)) or 'null'}) then 0.0 else {value('rv_h')} end"
        x = ["1.0", own, *[value(c) for c in logged[1:]], *m.base, *m.extra]
        whole = " and ".join(f"{c} is not null" for c in (*logged, *m.base, *m.extra, "rv_future"))
        parts.append(f"select {keys}, ts, {split} as split, rv_future, Z, '{m.name}' as family, '{m.spec}' as spec, {len(x) - len(m.extra)} as n_base, {value('rv_future')} as y, [{', '.join(f'({c})::double' for c in (*x, *['0.0'] * (width - len(x))))}] as x from {source} where {whole} and rv_future > 0")
    by = f"{keys}, family"
    made = lambda k: f"case spec when 'log_smear' then greatest(exp(list_inner_product(x, {k})) * {k}_smear, 1e-12) when 'log_no_smear' then greatest(exp(list_inner_product(x, {k})), 1e-12) else greatest(list_inner_product(x, {k}), floor, 1e-12) end"
    known = ", ".join(f"'{k}'" for k in train)
    return f"""{p}mr as materialized ({' union all '.join(parts)}), {p}tr as (select * from {p}mr where split in ({known})), {_solved_sql(width, keys, p).format(least=gates[0])},
 {p}sm as (select {by}, avg(exp(y - list_inner_product(x, base))) as base_smear, avg(exp(y - list_inner_product(x, more))) as more_smear, quantile_cont(rv_future, 0.005) as floor from {p}tr join {p}so using ({by}) group by {by}),
 {p}te as (select * from (select *, row_number() over (partition by {by} order by ts) as rn from {p}mr where split = '{test}') where (rn - 1) % horizon = 0),
 {p}ga as (select *, count(*) over (partition by {by}) as n_test from {p}te),
 {p}fo as (select {p}ga.*, {p}so.* exclude ({by}, n_base, n, g, b, yy), base_smear, more_smear, {made('base')} as bf, {made('more')} as af from {p}ga join {p}so using ({by}) join {p}sm using ({by}) where n_test >= {gates[1]}),
 {p}de as (select *, pow(rv_future - bf, 2) as bm, pow(rv_future - af, 2) as am, rv_future / bf - ln(rv_future / bf) - 1 as bq, rv_future / af - ln(rv_future / af) - 1 as aq, pow(rv_future - bf, 2) - (pow(rv_future - af, 2) - pow(bf - af, 2)) as cw from {p}fo)"""


#: Decimals to which the columns of a comparison are told.
DIGITS = {"base_r2": 5, "more_r2": 5, "base_smear": 5, "more_smear": 5, "baseline_mse": 7, "augmented_mse": 7, "baseline_qlike": 5, "augmented_qlike": 5, "mse_improvement": 4, "qlike_improvement": 5} | {f"{c}_{k}": d for c, m in (("mse_diff", 8), ("qlike_diff", 5), ("cw", 8)) for k, d in (("mean", m), ("t", 3), ("p", 4))}


def _student_upper_sql(t: str, df: str) -> str:
    return f"case when {t} > 0 then {_student_p(t, df)} / 2 else 1 - {_student_p(t, df)} / 2 end"


def comparison_sql(p: str = "", keys: str = "asset, horizon", law: str = "t") -> str:
    """CTEs ending in {p}co: one row a group of {p}de, as forecasting.comparison tells it."""
    by = f"{keys}, family"
    long = " union all ".join(f"select {by}, ts, '{c}' as series, {x} as x from {p}de" for c, x in (("mse_diff", "bm - am"), ("qlike_diff", "bq - aq"), ("cw", "cw")))
    nw = _nw_sql(f"{p}lo", "x", f"{by}, series").replace("nw", f"{p}nw")
    tail = _student_upper_sql("(mean / se)", "(n - 1)") if law == "t" else f"case when mean > 0 then {_normal_p('(mean / se)')} / 2 else 1 - {_normal_p('(mean / se)')} / 2 end"
    wide = ", ".join(f"any_value({k}) filter (series = '{c}') as {c}_{k}" for c in ("mse_diff", "qlike_diff", "cw") for k in ("mean", "t", "p"))
    return f"""{p}lo as ({long}), {nw}, {p}pv as (select *, mean / se as t, {tail} as p from {p}nw3), {p}wi as (select {by}, {wide} from {p}pv group by {by}),
 {p}me as (select {by}, count(*) as n_test, any_value(n_train) as n_train, {', '.join(f'any_value({c}) as {c}' for c in ('base_r2', 'more_r2', 'base_smear', 'more_smear'))}, avg(bm) as baseline_mse, avg(am) as augmented_mse, avg(bq) as baseline_qlike, avg(aq) as augmented_qlike from {p}de group by {by}),
 {p}co as (select *, 1 - augmented_mse / baseline_mse as mse_improvement, baseline_qlike - augmented_qlike as qlike_improvement from {p}me join {p}wi using ({by}))"""


def told(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, d) for c, d in DIGITS.items() if c in df.columns})


def told_sql(source: str, more: str = "") -> str:
    return f"select * replace ({', '.join(f'round({c}, {d}) as {c}' for c, d in DIGITS.items())}{more}) from {source}"


SAME = tuple(h for h in HORIZONS if h in FRAMES.values())


def _semi_columns() -> str:
    w = lambda n: f"over (partition by asset order by ts rows between {n - 1} preceding and current row)"
    x = {"rsv_neg": "case when ret < 0 then ret * ret else 0 end", "rsv_pos": "case when ret >= 0 then ret * ret else 0 end", "rq": "ret * ret * ret * ret"}
    return ", ".join(f"case when count({x[o]}) {w(n)} = {n} then sum({x[o]}) {w(n)}{f' * {n} / 3' if o == 'rq' else ''} end as {o}_past_{k}" for k, n in FRAMES.items() for o in x)


def clipped_long_sql(clip: tuple[float, float] | None = (0.005, 0.995)) -> str:
    """CTEs ending in lf: the day frame in long form by horizon, Z held within quantiles of the training rows."""
    z = "Z" if clip is None else "least(greatest(Z, lo), hi)"
    bounds = clip or (0.0, 1.0)
    each = " union all ".join(f"select asset, {h} as horizon, ts, {z} as Z, {', '.join(f'{kind}_past_{k}' for kind in ('rv', 'rsv_neg', 'rsv_pos', 'rq') for k in FRAMES)}, rv_past_{h} as rv_h, rv_future_{h} as rv_future from fz" for h in HORIZONS)
    return f"""{frame_sql()}, fb as (select asset, quantile_cont(Z, {bounds[0]}) as lo, quantile_cont(Z, {bounds[1]}) as hi from fr where Z is not null and {SPLIT_SQL} in ('train', 'validation') group by 1),
 fs as (select asset, ts, {_semi_columns()} from ret), fz as materialized (select fr.*, fs.* exclude (asset, ts), lo, hi from fr join fs using (asset, ts) left join fb using (asset)), lf as materialized ({each})"""


FAMILY_MODELS = [forecasting.Nested(f, f) for f in forecasting.FAMILIES]


@query(f"with recursive {clipped_long_sql()}, {nested_sql('lf', FAMILY_MODELS, same=SAME)}, {comparison_sql()} {told_sql('co')}")
def family_comparison(spark: SparkSession, d: str) -> DataFrame:
    return told(experiments.family_tests(day_frame(spark, d), HORIZONS, FRAMES))


def _selection_sql() -> str:
    order = " ".join(f"when '{f}' then {k}" for k, f in enumerate(forecasting.FAMILIES))
    return f"""with recursive {clipped_long_sql()}, {nested_sql('lf', FAMILY_MODELS, p='v', train=('train',), test='validation', same=SAME)}, vl as (select asset, horizon, family, avg(bq) as loss from vde group by 1, 2, 3),
 vb as (select asset, horizon, arg_min(family, row(loss, case family {order} end)) as family, min(loss) as validation_loss from vl group by 1, 2), {nested_sql('lf', FAMILY_MODELS, same=SAME)}, {comparison_sql()}, ch as (select co.*, validation_loss from co join vb using (asset, horizon, family))
 {told_sql('ch', ', round(validation_loss, 5) as validation_loss')}"""


@query(_selection_sql())
def family_selection(spark: SparkSession, d: str) -> DataFrame:
    return told(experiments.selected_family(day_frame(spark, d), HORIZONS, FRAMES)).withColumn("validation_loss", F.round("validation_loss", 5))


def _clips_sql() -> str:
    """CTEs ending in lc: the long rows once for every clip of Z."""
    cuts = [c for c in experiments.CLIPS if c]
    bounds = ", ".join(f"quantile_cont(Z, {low}) as lo{k}, quantile_cont(Z, {high}) as hi{k}" for k, (low, high) in enumerate(cuts))
    parts = ["select *, 'none' as clip from lf"] + [f"select lf.* replace (least(greatest(Z, lo{k}), hi{k}) as Z), '{low}-{high}' as clip from lf join cb using (asset)" for k, (low, high) in enumerate(cuts)]
    return f"""{clipped_long_sql(None)}, cb as (select asset, {bounds} from fr where Z is not null and {SPLIT_SQL} in ('train', 'validation') group by 1), lc as ({' union all '.join(parts)})"""


def _boot_sql(name: str, x: str, by: str, offset: int, length: int, replicates: int) -> str:
    """CTE {name} (by..., <name>_low, _high, _p): moving-block bootstraps of the mean of {x} over the details."""
    k, low = name, f"{name}_"
    same = lambda a, b: " and ".join(f"{a}.{c} = {b}.{c}" for c in by.split(", "))
    own = ", ".join(f"en.{c}" for c in by.split(", "))
    return f"""{low}o as (select {by}, row_number() over w as rn, sum({x}) over (partition by {by} order by ts rows unbounded preceding) as total, count(*) over (partition by {by}) as n, horizon + 42 + {offset} as seed from de window w as (partition by {by} order by ts)),
 {low}z as (select distinct {by}, n, least({length}, n) as len, seed from {low}o), {low}d as (select {by}, n, r, {LCG('r', 'b', 'seed')} % (n - len + 1) as start, least(len, n - b * len) as part from {low}z, (select unnest(range({replicates})) as r), (select unnest(range(200)) as b) where b < ceil(n / len)),
 {low}m as (select {own}, r, sum(hi.total - coalesce(lo.total, 0)) / any_value(en.n) as m from {low}d en join {low}o hi on {same('hi', 'en')} and hi.rn = en.start + en.part left join {low}o lo on {same('lo', 'en')} and lo.rn = en.start group by {own}, r),
 {k} as (select {by}, quantile_cont(m, 0.025) as {k}_low, quantile_cont(m, 0.975) as {k}_high, avg((m <= 0)::int) as {k}_p from {low}m group by {by})"""


BOOT_DIGITS = {f"{c}_boot_{k}": d for c, m in (("mse_diff", 8), ("qlike_diff", 5)) for k, d in (("low", m), ("high", m), ("p", 3))}


def _static_sql() -> str:
    models = [forecasting.Nested(k, spec=k) for k in ("log_smear", "log_no_smear", "level_floor")]
    keys, by = "asset, horizon, clip", "asset, horizon, clip, family"
    boots = ", ".join(_boot_sql(f"{c}_boot", x, by, o, 24, 1000) for c, x, o in (("mse_diff", "bm - am", 0), ("qlike_diff", "bq - aq", 10_000)))
    rounds = "".join(f", round({c}, {d}) as {c}" for c, d in BOOT_DIGITS.items())
    return f"""with recursive {_clips_sql()}, {nested_sql('lc', models, keys, same=SAME, gates=(50, 10))}, {comparison_sql(keys=keys, law='normal')}, {boots},
 al as (select co.* exclude (family), family as spec, 'HAR' as family, {', '.join(BOOT_DIGITS)} from co left join mse_diff_boot using ({by}) left join qlike_diff_boot using ({by})) {told_sql('al', rounds)}"""


@query(_static_sql())
def static_oos(spark: SparkSession, d: str) -> DataFrame:
    return told(experiments.specification_sweep(day_frame(spark, d), HORIZONS, FRAMES)).withColumns({c: F.round(c, digits) for c, digits in BOOT_DIGITS.items()})


RATE_MODELS = [forecasting.Nested(name, "HAR", extra, base) for name, (base, extra) in experiments.RATE_PAIRS.items()]
RATE_FRAMES, RATE_HORIZONS = {"d": 24, "w": 48, "m": 96}, (1, 4, 12, 24)


def _rates_sql() -> str:
    full = lambda a, b, n: f"case when count(r2) over (partition by asset order by ts rows between {a} and {b}) = {n} then sum(r2) over (partition by asset order by ts rows between {a} and {b}) end"
    rv = [f"{full(f'{h - 1} preceding', 'current row', h)} as rv_past_{h}, {full('1 following', f'{h} following', h)} as rv_future_{h}" for h in RATE_HORIZONS]
    har = [f"{full(f'{n - 1} preceding', 'current row', n)} as rv_past_{k}" for k, n in RATE_FRAMES.items()]
    each = " union all ".join(f"select asset, {h} as horizon, ts, least(greatest(Z, lo), hi) as Z, abs_rate_z, rate_change_bps, in_window, {', '.join(f'rv_past_{k}' for k in RATE_FRAMES)}, rv_past_{h} as rv_h, rv_future_{h} as rv_future from ra join rb using (asset) where abs_rate_z is not null and rate_change_bps is not null and rv_future_{h} > 0 and Z is not null" for h in RATE_HORIZONS)
    return f"""with recursive {HOUR}, {signal_sql('hour', HOUR_WINDOW)}, {_event_sql()}, k as (select funding_time, max(event_id) as event_id from evf group by 1), l as (select evf.* from evf join k using (funding_time, event_id)),
 bk as (select sig.*, (epoch_us(ts) - epoch_us(funding_time)) / 6e7 as before, abs_rate_z, rate_change_bps from (select * from sig where asset <> 'error') sig asof left join l on ts >= funding_time),
 ne as (select bk.*, (epoch_us(l.funding_time) - epoch_us(ts)) / 6e7 as after from bk asof left join l on ts <= l.funding_time), sq as (select *, ret * ret as r2, coalesce(least(before, after) <= 60, false)::int::double as in_window from ne), ra as materialized (select *, {', '.join(rv + har)} from sq),
 rb as (select asset, quantile_cont(Z, 0.005) as lo, quantile_cont(Z, 0.995) as hi from ra where Z is not null and {SPLIT_HOURS} in ('train', 'validation') group by 1), lr as materialized ({each}),
 {nested_sql('lr', RATE_MODELS, split=SPLIT_HOURS, same=tuple(h for h in RATE_HORIZONS if h in RATE_FRAMES.values()), frames=tuple(RATE_FRAMES))}, {comparison_sql()}, al as (select co.* exclude (family), family as model from co) {told_sql('al')}"""


@query(_rates_sql())
def funding_models(spark: SparkSession, d: str) -> DataFrame:
    return told(experiments.rate_models(hour_signal(spark, d).where("asset <> 'error'"), harness.rate_events(spark, d), RATE_HORIZONS))


WINDOWS = (11, 22, 44)


def _sensitivity_sql() -> str:
    keys = "window_rows, smoothing, pooling"
    signals = " union all ".join(f"select asset, ts, Z, {w} as window_rows, {s} as smoothing, '{k}' as pooling from (with {DAY}, {signal_sql('day', w, s, p)} select asset, ts, Z from sig)" for w in WINDOWS for s in (1, 3, 6) for k, p in (("max", "greatest(zV, zR)"), ("mean", "(zV + zR) / 2")))
    each = " union all ".join(f"select asset, {h} as horizon, ts, {keys}, least(greatest(sg.Z, lo), hi) as Z, {', '.join(f'rv_past_{k}' for k in FRAMES)}, rv_past_{h} as rv_h, rv_future_{h} as rv_future from sg join fr using (asset, ts) join sb using (asset, {keys}) where sg.Z is not null" for h in HORIZONS)
    return f"""with recursive {frame_sql()}, sg as materialized ({signals}), sb as (select asset, {keys}, quantile_cont(Z, 0.005) as lo, quantile_cont(Z, 0.995) as hi from sg where Z is not null and {SPLIT_SQL} in ('train', 'validation') group by all), ls as materialized ({each}),
 {nested_sql('ls', [forecasting.Nested('HAR')], f'asset, horizon, {keys}', same=SAME)}, {comparison_sql(keys=f'asset, horizon, {keys}')}, al as (select co.* exclude (window_rows), window_rows as "window" from co) {told_sql('al')}"""


@query(_sensitivity_sql())
def hyperparameter_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    return told(experiments.signal_sensitivity(day_returns(spark, d), HORIZONS, FRAMES, windows=WINDOWS))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return scheduled_window(spark, d)
