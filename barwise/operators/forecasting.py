"""Log-linear variance forecasts fitted by sums, and the losses of nested models at the same origins."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwise.functions.scalars import EPS, clark_west, finite, floored, qlike, ratio, safe_log, squared_error
from barwise.operators.inference import newey_west
from barwise.operators.quantiles import quantiles
from barwise.operators.settle import settled
from barwise.operators.splits import gated, in_split, nonoverlapping

FAMILIES = {"HAR": (), "HARQ": ("rq",), "RSV-HAR": ("rsv_neg", "rsv_pos")}


def fit_ols(df: DataFrame, y: str, xs: list[str], by=("asset",), ridge: float = 1e-10) -> DataFrame:
    """(by..., n, beta, gram, r2): normal equations with a ridge that spares the intercept.

    The sums are one aggregation; each group's k x k system is then solved where its row is.
    """
    k = len(xs) + 1
    column = lambda i: F.lit(1.0) if i == 0 else F.col(xs[i - 1]).cast("double")
    sums = [F.sum(column(i) * column(j)).alias(f"_g{i}_{j}") for i in range(k) for j in range(i, k)]
    sums += [F.sum(column(i) * F.col(y)).alias(f"_b{i}") for i in range(k)]
    totals = df.groupBy(*by).agg(*sums, F.sum(F.col(y) * F.col(y)).alias("_yy"), F.count("*").alias("n"))
    schema = df.select(*by).schema.simpleString()[7:-1].replace(":", " ") + ", n long, beta array<double>, gram array<double>, r2 double"

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                g = np.array([[row[f"_g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], dtype=float)
                b = np.array([row[f"_b{i}"] for i in range(k)], dtype=float)
                a = g + ridge * np.diag([0.0] + [1.0] * (k - 1))
                try:
                    beta = np.linalg.solve(a, b)
                except np.linalg.LinAlgError:
                    beta = np.linalg.pinv(a) @ b
                sse, sst = row["_yy"] - 2 * beta @ b + beta @ g @ beta, row["_yy"] - b[0] ** 2 / row["n"]
                out.append({c: row[c] for c in by} | {"n": row["n"], "beta": beta, "gram": g.ravel(), "r2": 1 - sse / sst if sst > 0 else None})
            yield pd.DataFrame(out, columns=[*by, "n", "beta", "gram", "r2"])

    return totals.mapInPandas(solve, schema)


def predicted(df: DataFrame, fits: DataFrame, xs: list[str], by=("asset",), name: str = "fit") -> DataFrame:
    """`df` with the fitted value of its group's model; groups without a model go."""
    value = reduce(lambda a, b: a + b, [F.col("beta")[0], *[F.col("beta")[i + 1] * F.col(x) for i, x in enumerate(xs)]])
    return df.join(fits.select(*by, "beta"), list(by)).withColumn(name, value).drop("beta")


def forecast(train: DataFrame, test: DataFrame, target: str, logged: list[str], plain: list[str] = (), by=("asset",), spec: str = "log_smear", ridge: float = 1e-10, name: str = "forecast") -> DataFrame:
    """`test` with a forecast of `target`, fitted on `train`; spec is log_smear, log_no_smear or level_floor.

    Columns in `logged` enter by their logarithm (in levels for level_floor), those in `plain` as they are.
    """
    if spec not in ("log_smear", "log_no_smear", "level_floor"):
        raise ValueError(f"unknown specification {spec!r}")
    level = spec == "level_floor"
    xs = [*[f"_x_{c}" for c in logged], *plain]
    ready = lambda df: df.withColumns({f"_x_{c}": F.col(c) if level else safe_log(c) for c in logged})
    rows = ready(train).withColumn("_y", F.col(target) if level else safe_log(target))
    fits = settled(fit_ols(rows, "_y", xs, by, ridge))  # one row a group; the smear and the test rows read it
    out = predicted(ready(test), fits, xs, by, "_f")
    if level:
        floor = quantiles(train, {"_floor": (target, 0.005)}, by)
        out = out.join(floor, list(by)).withColumn(name, F.greatest("_f", "_floor", F.lit(EPS)))
    elif spec == "log_smear":
        smear = settled(predicted(rows, fits, xs, by, "_f").groupBy(*by).agg(F.avg(F.exp(F.col("_y") - F.col("_f"))).alias("_smear")))
        out = out.join(smear, list(by)).withColumn(name, floored(F.exp("_f") * F.col("_smear")))
    else:
        out = out.withColumn(name, floored(F.exp("_f")))
    return out.drop("_f", "_smear", "_floor", *[f"_x_{c}" for c in logged])


def with_losses(df: DataFrame, y: str, baseline: str, augmented: str) -> DataFrame:
    """Adds both models' squared and QLIKE losses, their differences (above 0: the augmented is better), and the Clark-West series."""
    losses = {f"{k}_{n}": f(y, c) for k, c in (("baseline", baseline), ("augmented", augmented)) for n, f in (("mse", squared_error), ("qlike", qlike))}
    out = df.withColumns(losses)
    return out.withColumns({"mse_diff": F.col("baseline_mse") - F.col("augmented_mse"), "qlike_diff": F.col("baseline_qlike") - F.col("augmented_qlike"), "cw": clark_west(y, baseline, augmented)})


def by_horizon(features: DataFrame, horizons: tuple[int, ...], frames: tuple[str, ...], keep: tuple[str, ...] = ("Z",)) -> DataFrame:
    """The modelling frame in long form: (asset, horizon, ts, keep..., rv_h and the named frames' columns, rv_future)."""
    shared = [*keep, *[c for c in features.columns if any(c.endswith(f"_past_{k}") for k in frames)]]
    each = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"rv_past_{h}").alias("rv_h"), F.col(f"rv_future_{h}").alias("rv_future")) for h in horizons]))
    return features.select("asset", "ts", *shared, each.alias("_h")).select("asset", "_h.horizon", "ts", *shared, "_h.rv_h", "_h.rv_future")


class Nested(NamedTuple):
    """A pair of models: `family`'s frames and the columns of `base`, and the same with `extra`. The spec is forecast()'s."""

    name: str
    family: str = "HAR"
    extra: tuple[str, ...] = ("Z",)
    base: tuple[str, ...] = ()
    spec: str = "log_smear"

    def row(self, frames: tuple[str, ...], same: list[int], width: int) -> Column:
        """Whether the row is complete, and y and x of the pair: intercept, frames, base, extra, then zeros.

        rv_h is zero, and so without a coefficient, at the horizons `same` that one of the frames equals.
        """
        value = F.col if self.spec == "level_floor" else safe_log
        logged = ["rv_h", *[f"{kind}_past_{k}" for kind in ("rv", *FAMILIES[self.family]) for k in frames]]
        own = F.when(F.col("horizon").isin(same), 0.0).otherwise(value("rv_h"))
        base = [F.lit(1.0), own, *[value(c) for c in logged[1:]], *[F.col(c).cast("double") for c in self.base]]
        x = [*base, *[F.col(c).cast("double") for c in self.extra]]
        whole = reduce(lambda a, b: a & b, [*[finite(c) for c in (*logged, *self.base, *self.extra, "rv_future")], F.col("rv_future") > 0])
        return F.struct(whole.alias("whole"), F.lit(self.name).alias("family"), F.lit(self.spec).alias("spec"), F.lit(len(base)).alias("n_base"), value("rv_future").alias("y"), F.array(*x, *[F.lit(0.0)] * (width - len(x))).alias("x"))

    def width(self, frames: tuple[str, ...]) -> int:
        return 2 + len(frames) * (1 + len(FAMILIES[self.family])) + len(self.base) + len(self.extra)


def _fit_nested(train: DataFrame, by: list[str], width: int, least: int, ridge: float) -> DataFrame:
    """(by..., base, more, n_train, base_r2, more_r2): both models' coefficients and fits. The smaller one's sums are a corner of the larger one's."""
    pairs = [(i, j) for i in range(width) for j in range(i, width)]
    x = lambda i: F.col("x")[i]
    totals = train.groupBy(*by, "n_base").agg(F.count("*").alias("n"), F.array(*[F.sum(x(i) * x(j)) for i, j in pairs]).alias("g"), F.array(*[F.sum(x(i) * F.col("y")) for i in range(width)]).alias("b"), F.sum(F.col("y") * F.col("y")).alias("yy"))
    schema = train.select(*by).schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ") + ", base array<double>, more array<double>, n_train long, base_r2 double, more_r2 double"

    def coefficients(g: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
        used = np.flatnonzero(np.diag(g)[:n] > 0)
        a = g[np.ix_(used, used)] + ridge * np.diag((used > 0).astype(float))
        out = np.zeros(width)
        try:
            out[used] = np.linalg.solve(a, b[used])
        except np.linalg.LinAlgError:
            out[used] = np.linalg.pinv(a) @ b[used]
        return out

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                g, b = np.zeros((width, width)), np.array(row["b"], dtype=float)
                for (i, j), v in zip(pairs, row["g"]):
                    g[i, j] = g[j, i] = v
                base, more = coefficients(g, b, row["n_base"]), coefficients(g, b, width)
                whole = row["yy"] - b[0] ** 2 / row["n"]  # the first regressor is the intercept
                r2 = [1 - (row["yy"] - 2 * beta @ b + beta @ g @ beta) / whole if whole > 0 else None for beta in (base, more)]
                out.append({c: row[c] for c in by} | {"base": base, "more": more, "n_train": row["n"], "base_r2": r2[0], "more_r2": r2[1]})
            yield pd.DataFrame(out, columns=[*by, "base", "more", "n_train", "base_r2", "more_r2"])

    return totals.where(F.col("n") >= least).mapInPandas(solve, schema)


#: What a detail row tells of its pair's fit: training rows, both R2, both smears.
FITS = ("n_train", "base_r2", "more_r2", "base_smear", "more_smear")


def details(frame: DataFrame, frames: tuple[str, ...], horizons: dict[int, str | None], models: list[Nested], train=("train", "validation"), test=("test",), splits=None, gates: tuple[int, int] = (100, 20), also: tuple[str, ...] = (), ridge: float = 1e-10) -> DataFrame:
    """Losses by origin of every pair in `models` (its name is `family`), on test origins `horizon` rows apart.

    `horizons` says for each which frame equals it, so that it does not enter twice (None: none). `also` are
    further keys of the series. All pairs share one pass for their sums, one for their smears and one over the
    test rows; `frame` is read three times and should be a settled table.
    """
    by, width = ["asset", "horizon", *also, "family"], max(m.width(frames) for m in models)
    same = [h for h, k in horizons.items() if k is not None]
    each = F.explode(F.array(*[m.row(frames, same, width) for m in models]))
    in_range = lambda names: in_split(frame, names, splits) if splits else in_split(frame, names)
    spread = lambda df: df.where(F.col("horizon").isin(list(horizons))).select("asset", "horizon", *also, "ts", "rv_future", "Z", each.alias("_m")).where("_m.whole").select("*", "_m.family", "_m.spec", "_m.n_base", "_m.y", "_m.x").drop("_m")
    fitted = lambda beta: reduce(lambda a, b: a + b, [F.col("x")[i] * F.col(beta)[i] for i in range(width)])
    fit_rows = spread(in_range(train))
    fits = settled(_fit_nested(fit_rows, by, width, gates[0], ridge))  # a row a model
    smears = fit_rows.join(fits, by).groupBy(*by).agg(*[F.avg(F.exp(F.col("y") - fitted(k))).alias(f"{k}_smear") for k in ("base", "more")])
    leveled = [m.name for m in models if m.spec == "level_floor"]
    floors = quantiles(fit_rows.where(F.col("family").isin(leveled)), {"floor": ("rv_future", 0.005)}, by) if leveled else None
    known = fits.join(smears, by)
    known = settled(known.join(floors, by, "left") if leveled else known.withColumn("floor", F.lit(None).cast("double")))
    asked = gated(nonoverlapping(spread(in_range(test)), "horizon", by), by, gates[1]).join(known, by)

    def made(k: str) -> Column:
        f = fitted(k)
        return F.when(F.col("spec") == "log_smear", floored(F.exp(f) * F.col(f"{k}_smear"))).when(F.col("spec") == "log_no_smear", floored(F.exp(f))).otherwise(F.greatest(f, "floor", F.lit(EPS)))

    both = asked.withColumns({"baseline_forecast": made("base"), "augmented_forecast": made("more")})
    return with_losses(both, "rv_future", "baseline_forecast", "augmented_forecast").select(*by, "ts", "rv_future", "Z", "baseline_forecast", "augmented_forecast", "baseline_mse", "augmented_mse", "baseline_qlike", "augmented_qlike", "mse_diff", "qlike_diff", "cw", *FITS)


def comparison(detail: DataFrame, law: str = "t", by=("asset", "horizon", "family")) -> DataFrame:
    """One row per group: the fits, mean losses, improvements, and Newey-West tests of both loss differences and of Clark-West."""
    by, series = list(by), ("mse_diff", "qlike_diff", "cw")
    detail = settled(detail)  # origins only; three passes read them
    fits = [c for c in FITS if c in detail.columns]
    means = detail.groupBy(*by).agg(F.count("*").alias("n_test"), *[F.first(c).alias(c) for c in fits], *[F.avg(c).alias(c) for c in ("baseline_mse", "augmented_mse", "baseline_qlike", "augmented_qlike")])
    out = means.withColumns({"mse_improvement": 1 - F.col("augmented_mse") / F.nullif(F.col("baseline_mse"), F.lit(0.0)), "qlike_improvement": F.col("baseline_qlike") - F.col("augmented_qlike")})
    long = detail.select(*by, "ts", F.expr(f"stack({len(series)}, {', '.join(f"'{c}', {c}" for c in series)}) as (series, x)"))
    tests = newey_west(long, "x", (*by, "series"), ("ts",), law=law)
    wide = tests.groupBy(*by).agg(*[F.first(F.when(F.col("series") == c, F.col(x)), ignorenulls=True).alias(f"{c}_{x}") for c in series for x in ("mean", "t", "p")])
    return out.join(wide, by, "left")


def best_family(validation: DataFrame, loss: str = "qlike") -> DataFrame:
    """(asset, horizon, family): the one of least mean validation loss, `qlike` or `mse`; the first listed wins ties."""
    rank = F.coalesce(*[F.when(F.col("family") == k, F.lit(i)) for i, k in enumerate(FAMILIES)])
    losses = validation.groupBy("asset", "horizon", "family").agg(F.avg(f"baseline_{loss}").alias("loss"))
    return losses.groupBy("asset", "horizon").agg(F.min_by("family", F.struct("loss", rank)).alias("family"), F.min("loss").alias("validation_loss"))


def margins(validation: DataFrame, test: DataFrame, forecasts: dict[str, Column], alphas: tuple[float, ...] = (0.01, 0.05), by=("asset",)) -> DataFrame:
    """Margin = forecast times the (1 - alpha) quantile of outcome over forecast in validation; how often outcomes exceed it."""
    spread = lambda df: df.select(*by, "rv_future", F.explode(F.array(*[F.struct(F.lit(k).alias("model"), f.alias("f")) for k, f in forecasts.items()])).alias("_m")).select(*by, "rv_future", "_m.*")
    r = F.col("rv_future") / floored("f")
    multiples = quantiles(spread(validation), {f"_k{i}": (r, 1 - a) for i, a in enumerate(alphas)}, (*by, "model"))
    long = multiples.select(*by, "model", F.explode(F.array(*[F.struct(F.lit(a).alias("alpha"), F.col(f"_k{i}").alias("multiplier")) for i, a in enumerate(alphas)])).alias("_a")).select(*by, "model", "_a.*")
    made = spread(test).join(long, [*by, "model"]).withColumn("margin", F.col("multiplier") * F.col("f"))
    means = made.groupBy(*by, "alpha", "model").agg(F.first("multiplier").alias("multiplier"), F.avg((F.col("rv_future") > F.col("margin")).cast("double")).alias("exceedance"), F.avg("margin").alias("mean_margin"), F.count("*").alias("n"))
    return means.join(quantiles(made, {"median_margin": ("margin", 0.5)}, (*by, "alpha", "model")), [*by, "alpha", "model"])


def margin_table(validation: DataFrame, test: DataFrame, alphas: tuple[float, ...] = (0.05, 0.10), by=("asset", "horizon")) -> DataFrame:
    """(by..., alpha, model, multiplier, exceedance, coverage, mean_margin, median_margin, margin_over_rv, reduction_pct, n).

    Both models' margins on the test details, at multipliers that meet the target in the validation details, and a third row of
    their differences (augmented less baseline) with the share of the margin that the augmented model saves.
    """
    by = list(by)
    models = {"baseline": F.col("baseline_forecast"), "augmented": F.col("augmented_forecast")}
    bounded = lambda df: df.withColumn("rv_future", floored("rv_future"))
    test = settled(bounded(test))
    mean = test.groupBy(*by).agg(F.avg("rv_future").alias("_rv"))
    each = settled(margins(bounded(validation), test, {k: floored(f) for k, f in models.items()}, alphas, by).join(mean, by))
    each = each.select(*by, "alpha", "model", "multiplier", "exceedance", (1 - F.col("exceedance")).alias("coverage"), "mean_margin", "median_margin", (F.col("mean_margin") / F.col("_rv")).alias("margin_over_rv"), F.lit(None).cast("double").alias("reduction_pct"), "n")
    of = lambda c, k: F.max(F.when(F.col("model") == k, F.col(c)))
    gap = lambda c: (of(c, "augmented") - of(c, "baseline")).alias(c)
    saved = (100 * ratio(of("mean_margin", "baseline") - of("mean_margin", "augmented"), of("mean_margin", "baseline"))).alias("reduction_pct")
    both = each.groupBy(*by, "alpha").agg(F.lit(None).cast("double").alias("multiplier"), *[gap(c) for c in ("exceedance", "coverage", "mean_margin", "median_margin", "margin_over_rv")], saved, F.max("n").alias("n"), F.count("*").alias("_models"))
    return each.unionByName(both.where("_models = 2").drop("_models").withColumn("model", F.lit("augmented vs baseline")))
