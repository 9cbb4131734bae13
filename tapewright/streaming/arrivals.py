"""Averages, returns and limit-up streaks of bars as they arrive, from a small state an instrument and not from its history.

The state keeps the closes that the longest average needs, the last bar and its streak. It is forgotten when an instrument has had no
bar for ``idle_days`` before the stream's latest date, by a timer, so it is bounded by the instruments alive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.market import limit_of
from ..sources.shared import on_workers

STATE = "date date, cents array<long>, close double, streak long"


def _running(lengths: tuple[int, ...]) -> Callable:
    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        date, cents, close, streak = state.get if state.exists else (None, [], None, 0)
        new = pd.concat(list(rows)).sort_values("date").drop_duplicates("date", keep="last")
        if date is not None:
            new = new[new["date"] > date]
        latest = new["date"].iloc[-1] if len(new) else date
        # the watermark is idle_days behind the stream; due when it has passed the last bar
        state.setTimeoutTimestamp(max(int(pd.Timestamp(latest).timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        if new.empty:
            return
        old = len(cents)
        every = np.concatenate([np.asarray(cents, "i8"), np.rint(new["close_adj"].to_numpy("f8") * 100).astype("i8")])
        total = np.concatenate([[0], np.cumsum(every)])
        ends = np.arange(old + 1, len(every) + 1)
        out = pd.DataFrame({"symbol": key[0], "date": new["date"]})
        for n in lengths:
            starts = np.maximum(ends - n, 0)
            out[f"ma{n}"] = (total[ends] - total[starts]) / (ends - starts) / 100.0
        now = new["close"].to_numpy("f8")
        before = np.concatenate([[np.nan if close is None else close], now[:-1]])
        before[before == 0] = np.nan
        ret = (now - before) / before * 100
        at_limit = ret >= new["limit"].to_numpy("f8")  # without a limit or a bar before: false
        streaks = []
        for hit in at_limit.tolist():
            streak = streak + 1 if hit else 0
            streaks.append(streak)
        state.update((latest, every[-max(lengths) :].tolist(), float(now[-1]), int(streak)))
        out["ret"] = pd.array(ret, "Float64")  # no number: null
        out["streak"] = streaks
        yield out

    return step


def on_arrival(bars: DataFrame, lengths: tuple[int, ...] = (5, 20), idle_days: int = 400) -> DataFrame:
    """symbol, date, ma<n> of close_adj, ret (unadjusted, percent) and streak of limit-ups for each new bar of a stream.

    Bars are symbol, date, close and close_adj without nulls. A batch may bring many bars of an instrument; a bar that is not later
    than those before it is passed over, of bars of one day in a batch one counts. Bars more than
    ``idle_days`` behind the stream's latest date are too late, and an instrument that comes back after so long starts anew. Its closes in state are as they were when they came: after a corporate action an instrument is better
    replayed from the store under a new checkpoint.
    """
    on_workers(bars.sparkSession)
    rows = bars.select("symbol", F.col("date").cast("date").alias("date"), F.col("close").cast("double").alias("close"), F.col("close_adj").cast("double").alias("close_adj"), limit_of(F.col("symbol")).alias("limit"), F.col("date").cast("timestamp").alias("_at")).withWatermark("_at", f"{idle_days} days")
    schema = "symbol string, date date, " + ", ".join(f"ma{n} double" for n in lengths) + ", ret double, streak long"
    return rows.groupBy("symbol").applyInPandasWithState(_running(lengths), schema, STATE, "append", GroupStateTimeout.EventTimeTimeout)
