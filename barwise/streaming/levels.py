"""Leaky support and resistance of a stream of signal rows, with the levels kept as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barwise.operators.recursion import LeakyState

STATE = "last long, fast double, slow double, resistance double, support double"
LEVELS = "asset string, ts timestamp, fast double, slow double, leaky_resistance double, leaky_support double, late boolean"


class LeakyLevels(StatefulProcessor):
    """An asset's levels for every setting, moved by its rows in time order, and the time of its last row.

    A batch's rows are put in order before they move the levels. A row at or before the last one of an earlier batch is late: it
    comes out with null levels and moves nothing. A row that repeats a time within a batch is run in the order of its price.
    """

    def __init__(self, settings: list[tuple[float, float]], zeta: float):
        self.settings, self.zeta = settings, zeta

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("levels", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = list(self.held.get()) if self.held.exists() else []
        states = [LeakyState(f, s, self.zeta) for f, s in self.settings]
        for state, row in zip(states, held):
            if row[3] is not None and row[3] == row[3]:
                state.levels = (row[3], row[4])
        batch = pd.concat(list(rows)).sort_values(["micros", "log_close"], kind="stable")
        late = batch["micros"].to_numpy() <= held[0][0] if held else np.zeros(len(batch), dtype=bool)
        due = batch[~late]
        for state in states:
            r, s = state.run(due["log_close"].to_numpy(float), due["Z"].to_numpy(float))
            yield self._rows(key, due, state, r, s, False)
            if late.any():
                empty = np.full(int(late.sum()), np.nan)
                yield self._rows(key, batch[late], state, empty, empty, True)
        if len(due):
            now = int(due["micros"].iloc[-1])
            self.held.put([(now, f, s, *(state.levels or (float("nan"), float("nan")))) for (f, s), state in zip(self.settings, states)])

    def _rows(self, key, rows: pd.DataFrame, state: LeakyState, r: np.ndarray, s: np.ndarray, late: bool) -> pd.DataFrame:
        return pd.DataFrame({"asset": key[0], "ts": rows["ts"], "fast": state.fast, "slow": state.slow, "leaky_resistance": pd.array(r, "Float64"), "leaky_support": pd.array(s, "Float64"), "late": late})

    def close(self) -> None:
        pass


def stream_leaky_extrema(signal: DataFrame, settings: list[tuple[float, float]], zeta: float = 1.0) -> DataFrame:
    """The rows of `leaky_extrema` for a stream (asset, ts timestamp, log_close, Z), and whether each came late.

    State is two levels for each asset and setting, in the state store of the query's checkpoint: a query started again there
    goes on where it stopped. The stream may be read in any number of batches.
    """
    rows = signal.select("asset", "ts", "log_close", "Z", F.unix_micros("ts").alias("micros")).groupBy("asset")
    return rows.transformWithStateInPandas(LeakyLevels([(float(a), float(b)) for a, b in settings], zeta), LEVELS, "Append", "None")
