"""Nested forecasts against numpy's least squares."""

import datetime as dt

import numpy as np
import pytest

from barwise.operators import forecasting


def test_nested_pairs_equal_least_squares(spark):
    rng = np.random.default_rng(3)
    start = dt.datetime(1998, 1, 1)
    rows = [("X", h, start + dt.timedelta(days=k), *map(float, (rng.normal(), *np.exp(rng.normal(size=3))))) for h in (2, 5) for k in range(800)]
    rows[10] = (*rows[10][:3], None, *rows[10][4:])  # incomplete only for pairs that use Z
    frame = spark.createDataFrame(rows, "asset string, horizon int, ts timestamp_ntz, Z double, rv_h double, rv_past_d double, rv_future double")
    models = [forecasting.Nested("z"), forecasting.Nested("level", spec="level_floor"), forecasting.Nested("plain", extra=(), spec="log_no_smear")]
    made = forecasting.details(frame, ("d",), {2: None, 5: "d"}, models, gates=(100, 5)).collect()
    got = {(r.family, r.horizon, r.ts): r for r in made}
    assert len(got) == len(made)
    for horizon in (2, 5):
        for name, level, extra in (("z", False, True), ("level", True, True), ("plain", False, False)):
            f = (lambda x: x) if level else np.log
            mine = [r for r in rows if r[1] == horizon and (r[3] is not None or not extra)]
            fit = [r for r in mine if r[2].year < 2000]
            asked = [r for r in mine if r[2].year == 2000][::horizon]

            def design(part, more):
                part = np.array([r[3:] for r in part], dtype=float)
                return np.column_stack([np.ones(len(part)), *([f(part[:, 1])] if horizon == 2 else []), f(part[:, 2]), *([part[:, 0]] if more else [])])

            y = f(np.array([r[6] for r in fit]))
            for column, more in (("baseline_forecast", False), ("augmented_forecast", extra)):
                beta = np.linalg.lstsq(design(fit, more), y, rcond=None)[0]
                value = design(asked, more) @ beta
                if level:
                    value = np.maximum(value, np.quantile([r[6] for r in fit], 0.005))
                else:
                    value = np.exp(value) * (np.exp(y - design(fit, more) @ beta).mean() if name == "z" else 1)
                assert [got[name, horizon, r[2]][column] for r in asked] == pytest.approx(list(value), rel=1e-6)
                r2 = 1 - ((y - design(fit, more) @ beta) ** 2).sum() / ((y - y.mean()) ** 2).sum()
                assert got[name, horizon, asked[0][2]]["more_r2" if more or column.startswith("aug") else "base_r2"] == pytest.approx(r2)
            assert got[name, horizon, asked[0][2]].n_train == len(fit)
            assert sum(k[:2] == (name, horizon) for k in got) == len(asked)
