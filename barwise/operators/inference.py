"""Statistics of dependent series: autocorrelation, Newey-West means, HAC regressions, batch means.

Lagged products are summed over chunks of a series, each with the rows that follow it, so a long series is many tasks
and the rows times lags are never rows of a table. Within a chunk they come from spectra, all lags at once.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwise.functions.distributions import normal_p_upper, student_p_upper
from barwise.functions.scalars import ratio
from barwise.operators.chunks import in_chunks, numbered
from barwise.operators.settle import settled


def lagged_products(own: np.ndarray, whole: np.ndarray, max_lag: int, block: int = 8_192) -> np.ndarray:
    """(lag, a, b): the sum over rows t of `own` of own[t, a] whole[t + lag, b], for lags 0..max_lag.

    Overlap-add: blocks of rows meet the rows that they reach, padded so that nothing wraps around. The blocks' cross
    spectra are summed, and one inverse gives all lags, in n log n steps whatever their number.
    """
    block = max(64, min(block, len(own))) if max_lag < block else max_lag
    size = 1 << (block + max_lag - 1).bit_length()
    spectrum = np.zeros((size // 2 + 1, own.shape[1], whole.shape[1]), dtype=complex)
    for start in range(0, len(own), block):
        a = np.fft.rfft(own[start : start + block], size, axis=0)
        b = np.fft.rfft(whole[start : start + block + max_lag], size, axis=0)
        spectrum += a.conj()[:, :, None] * b[:, None, :]
    return np.fft.irfft(spectrum, size, axis=0)[: max_lag + 1]


def lagged_sums(df: DataFrame, columns: list[str], max_lag: int, by=("asset",), time: str = "ts", span: str = "month") -> DataFrame:
    """(by..., lag, <a>_<b>...): for each lag, the sum over t of a(t) b(t + lag) for all pairs of columns.

    A chunk is a calendar span of a series and the spans after it that its last rows reach by `max_lag` rows, as
    the spans' counts tell. `df` is read twice and should be a settled table.
    """
    by = list(by)
    rows = df.select(*by, time, *columns).withColumn("_span", F.date_trunc(span, time))
    before = Window.partitionBy(*by).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.groupBy(*by, "_span").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    own, other = (spans.select(*[F.col(c).alias(f"{k}{c}") for c in (*by, "_span", "_n", "_start")]) for k in ("own_", "other_"))
    same = [F.col(f"own_{c}").eqNullSafe(F.col(f"other_{c}")) for c in by]
    reached = (F.col("other__start") >= F.col("own__start")) & (F.col("other__start") < F.col("own__start") + F.col("own__n") + max_lag)
    homes = other.join(own, [*same, reached]).groupBy(*[f"other_{c}" for c in (*by, "_span")]).agg(F.collect_list("own__span").alias("_homes"))
    meet = [F.col(c).eqNullSafe(F.col(f"other_{c}")) for c in (*by, "_span")]
    spread = rows.join(homes, meet).select(*by, time, *columns, "_span", F.explode("_homes").alias("_home"))
    names = [f"{a}_{b}" for a in columns for b in columns]
    schema = ", ".join([*(f"`{c}` {dict(df.dtypes)[c]}" for c in by), "lag int", *(f"`{c}` double" for c in names)])

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time, kind="stable")
        x = np.nan_to_num(pdf[columns].to_numpy(float))
        n = int((pdf["_span"] == pdf["_home"]).sum())
        sums = lagged_products(x[:n], x, min(max_lag, len(x) - 1))
        out = pd.DataFrame(sums.reshape(len(sums), -1), columns=names)
        out.insert(0, "lag", np.arange(len(out), dtype=np.int32))
        for k, c in enumerate(by):
            out.insert(k, c, pdf[c].iloc[0])
        return out

    parts = spread.groupBy(*by, "_home").applyInPandas(summed, schema)
    return parts.groupBy(*by, "lag").agg(*[F.sum(c).alias(c) for c in names])


def _centred(df: DataFrame, value: str, by) -> DataFrame:
    rows = df.where(F.col(value).isNotNull())
    means = rows.groupBy(*by).agg(F.avg(value).alias("_mean"), F.count("*").alias("n"))
    return rows.join(means, list(by)).withColumn("c", F.col(value) - F.col("_mean"))


def autocorrelations(df: DataFrame, value: str, max_lag: int, by=("asset",), order=("ts",)) -> DataFrame:
    """(by..., lag, acf) for lags 1..max_lag over the rows where the value is there; short or constant series give none."""
    rows = settled(_centred(df, value, by).where(F.col("n") > max_lag + 1).select(*by, *order, "c"))
    sums = lagged_sums(rows, ["c"], max_lag, by, *order)
    whole = sums.where("lag = 0").select(*by, F.col("c_c").alias("_whole"))
    return sums.where("lag > 0").join(whole, list(by)).where("_whole > 0").select(*by, "lag", (F.col("c_c") / F.col("_whole")).alias("acf"))


def acf_errors(acf: DataFrame, slopes: DataFrame, by=("asset",), of=("asset",)) -> DataFrame:
    """The autocorrelations beside slope^lag of a first-order fit, whose keys are `of`."""
    implied = F.pow("slope", "lag")
    return acf.join(slopes.select(*of, "slope"), list(of)).select(*by, "lag", "acf", implied.alias("implied_acf"), F.abs(F.col("acf") - implied).alias("abs_error"), F.pow(F.col("acf") - implied, F.lit(2)).alias("squared_error"))


def acf_summary(errors: DataFrame, by=("asset",)) -> DataFrame:
    return errors.groupBy(*by).agg(F.max("lag").alias("max_lag"), F.avg("abs_error").alias("acf_mae"), F.sqrt(F.avg("squared_error")).alias("acf_rmse"), F.max("abs_error").alias("acf_max_abs_error"))


def newey_west(df: DataFrame, value: str, by=("asset",), order=("ts",), lags: int | None = None, law: str = "t") -> DataFrame:
    """(by..., n, lags, mean, se, t, p): is the mean above 0? Bartlett weights; lags by default floor(sqrt(n)).

    t and p are null for fewer than 3 rows and for series without variance.
    """
    rows = _centred(settled(df.select(*by, *order, value)), value, by)
    most = lags if lags is not None else int((rows.agg(F.max("n")).first()[0] or 0) ** 0.5)
    sums = lagged_sums(rows, ["c"], most, by, *order)
    sizes = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    used = F.least(F.floor(F.sqrt("n")) if lags is None else F.lit(lags), F.col("n") - 1)
    weight = F.when(F.col("lag") == 0, 1.0).when(F.col("lag") <= used, 2 * (1 - F.col("lag") / (used + 1))).otherwise(0.0)
    variance = sums.join(sizes, list(by)).groupBy(*by).agg(F.first("n").alias("n"), F.first("mean").alias("mean"), (F.sum(weight * F.col("c_c")) / F.first("n")).alias("lrv"))
    se = F.sqrt(F.greatest(F.col("lrv") / F.col("n"), F.lit(0.0)))
    out = variance.select(*by, "n", used.cast("int").alias("lags"), "mean", se.alias("se"), F.when((F.col("n") >= 3) & (se > 0), F.col("mean") / se).alias("t"))
    return out.withColumn("p", student_p_upper("t", F.col("n") - 1) if law == "t" else normal_p_upper("t"))


def hac_regression(df: DataFrame, y: str, xs: list[str], max_lag: int | str, by=("asset",), order=("ts",)) -> DataFrame:
    """(by..., n, coef, t_hac, p_hac, r2), arrays with the intercept first. Sums and score products are Spark's; only k x k matrices reach Python.

    max_lag is a number, or the name of one of the keys, which then holds each group's own.
    """
    from barwise.operators.forecasting import fit_ols, predicted

    most = max_lag if isinstance(max_lag, int) else int(df.agg(F.max(max_lag)).first()[0] or 0)
    rows = df.where(" and ".join(f"{c} is not null" for c in [y, *xs]))
    fits = fit_ols(rows, y, xs, by, ridge=0.0)
    k = len(xs) + 1
    scored = predicted(rows, fits, xs, by, "_fit").withColumn("_e", F.col(y) - F.col("_fit"))
    scored = scored.withColumns({f"u{i}": F.col("_e") * (F.lit(1.0) if i == 0 else F.col(xs[i - 1])) for i in range(k)})
    us = [f"u{i}" for i in range(k)]
    sums = lagged_sums(settled(scored.select(*by, *order, *us)), us, most, by, *order)
    weighted = sums.groupBy(*by).agg(F.collect_list(F.struct("lag", F.array(*[f"{a}_{b}" for a in us for b in us]).alias("g"))).alias("sums"))
    schema = fits.select(*by).schema.simpleString()[7:-1].replace(":", " ") + ", n long, coef array<double>, t_hac array<double>, p_hac array<double>, r2 double"

    def sandwich(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                s, lags = np.zeros((k, k)), max_lag if isinstance(max_lag, int) else int(row[max_lag])
                for item in row["sums"]:
                    g = np.array(item["g"], dtype=float).reshape(k, k)
                    s += g if item["lag"] == 0 else max(0.0, 1 - item["lag"] / (lags + 1)) * (g + g.T)
                inverse = np.linalg.pinv(np.array(row["gram"], dtype=float).reshape(k, k))
                se = np.sqrt(np.maximum(np.diag(inverse @ s @ inverse), 0))
                beta = np.array(row["beta"], dtype=float)
                t = [b / e if e > 0 else None for b, e in zip(beta, se)]
                p = [None if x is None else math.erfc(abs(x) / math.sqrt(2)) for x in t]
                out.append({c: row[c] for c in by} | {"n": row["n"], "coef": beta, "t_hac": t, "p_hac": p, "r2": row["r2"]})
            yield pd.DataFrame(out, columns=[*by, "n", "coef", "t_hac", "p_hac", "r2"])

    return fits.join(weighted, list(by)).mapInPandas(sandwich, schema)


def batched(df: DataFrame, value: str, batches: int = 100, by=("asset",)) -> DataFrame:
    """The rows with a value, each with the number of its _batch: equal runs of rows, the tail left out."""
    by = list(by)
    placed = settled(numbered(df.where(F.col(value).isNotNull()), by=by))
    n = placed.groupBy(*by).agg(F.count("*").alias("_n"))
    known = placed.join(n.select(*[F.col(c).alias(f"_of_{c}") for c in by], "_n"), [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by])
    most = F.greatest(F.lit(2), F.least(F.lit(batches), F.col("_n")))
    return known.withColumn("_batch", F.floor(F.col("rn") / F.greatest(F.lit(1), F.floor(F.col("_n") / most)))).where(F.col("_batch") < most).select(*df.columns, "_batch")


def batch_means(df: DataFrame, value: str, batches: int = 100, by=("asset",)) -> DataFrame:
    """(by..., statistic, estimate, batch_se, batches) of mean, std, skewness and kurtosis over equal runs of rows; the tail is left out."""
    each = batched(df, value, batches, by).groupBy(*by, "_batch").agg(*[f.alias(k) for k, f in moments(value).items()])
    long = each.select(*by, F.expr("stack(4, 'mean', mean, 'std', std, 'skewness', skewness, 'kurtosis', kurtosis) as (statistic, x)"))
    return long.groupBy(*by, "statistic").agg(F.avg("x").alias("estimate"), (F.stddev_samp("x") / F.sqrt(F.count("x"))).alias("batch_se"), F.count("*").alias("batches"))


def moments(value: str) -> dict:
    """Mean, population deviation, and the plain (biased, not excess) third and fourth standardised moments."""
    return {"mean": F.avg(value), "std": F.stddev_pop(value), "skewness": F.skewness(value), "kurtosis": F.kurtosis(value) + 3}


def _neighbours(df: DataFrame, value: str, by) -> DataFrame:
    """(by..., x, y): each row's value and the next one's in order of ts, over the rows that have a value; by chunks of a series."""
    rows = df.where(F.col(value).isNotNull()).select(*by, "ts", F.col(value).alias("x"))
    following = lambda part, keys: part.withColumn("y", F.lead("x").over(Window.partitionBy(*keys).orderBy("ts")))
    return in_chunks(rows, following, back=0, ahead=1, by=tuple(by)).where("y is not null").select(*by, "x", "y")


def first_order_fit(df: DataFrame, value: str, days_per_row: float, by=("asset",)) -> DataFrame:
    """(by..., n, slope, intercept, r2, kappa, level, sigma, half_life_hours) of x(t+1) on x(t).

    The mean-reversion figures are null unless the slope is between 0 and 1; groups of fewer than 3 rows give none.
    """
    pairs = _neighbours(df, value, by)
    fits = pairs.groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"), F.var_pop("y").alias("_v")).where("n >= 2")
    b = F.col("slope")
    kappa = F.when((b > 0) & (b < 1), -F.ln(b) / days_per_row)
    s2 = F.col("_v") * (1 - F.col("r2"))
    return fits.select(*by, "n", "slope", "intercept", "r2", kappa.alias("kappa"), F.when(kappa.isNotNull(), ratio(F.col("intercept"), 1 - b)).alias("level"), F.sqrt(s2 * 2 * kappa / (1 - b * b)).alias("sigma"), (24 * F.ln(F.lit(2.0)) / kappa).alias("half_life_hours"))


def first_order_check(df: DataFrame, fits: DataFrame, value: str, by=("asset",)) -> DataFrame:
    """(by..., n, r2_oos, rmse, corr) of one-step predictions by given fits (joined on asset)."""
    pairs = _neighbours(df, value, by)
    made = pairs.join(fits.select("asset", "slope", "intercept"), "asset").withColumn("f", F.col("intercept") + F.col("slope") * F.col("x"))
    sse = F.sum(F.pow(F.col("y") - F.col("f"), F.lit(2)))
    return made.groupBy(*by).agg(F.count("*").alias("n"), (1 - ratio(sse, F.var_pop("y") * F.count("*"))).alias("r2_oos"), F.sqrt(sse / F.count("*")).alias("rmse"), F.corr("y", "f").alias("corr"))
