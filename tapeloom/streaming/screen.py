"""Screening of a stream of bars, instrument by instrument, with the bars that the formula looks back on as state."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tapeloom.screener.formula import FormulaError, lookback, parse
from tapeloom.screener.session import run

_FIELDS = ("open", "high", "low", "close", "vol", "amount")
_STATE = "days array<int>, " + ", ".join(f"{f} array<double>" for f in _FIELDS)


def screen_stream(bars: DataFrame, formula: str) -> DataFrame:
    """Hits (ts_code, date, value) of a streaming DataFrame of bars, in append mode.

    State per instrument is its last ``lookback`` bars, whatever the history's length; a formula that needs
    the whole history is an error. Bars must arrive in date order per instrument across batches; within
    a batch they are sorted; a bar on or before the last seen day is ignored.
    """
    statements = parse(formula)
    depth = lookback(statements)
    if depth is None:
        raise FormulaError("the formula needs the whole history and cannot run on a stream")

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fresh = pd.concat(list(parts)).sort_values("date")
        days = (pd.to_datetime(fresh["date"]) - pd.Timestamp(0)).dt.days.to_numpy()
        held = state.get if state.exists else ([], *[[] for _ in _FIELDS])
        new = days > (held[0][-1] if len(held[0]) else -(10**9))
        all_days = np.concatenate([np.asarray(held[0], int), days[new]])
        values = {f: np.concatenate([np.asarray(h, float), fresh[f].to_numpy(float)[new]]) for f, h in zip(_FIELDS, held[1:], strict=True)}
        got = run(statements, values)
        hit = np.isfinite(got) & (got != 0) & (np.arange(len(got)) >= len(held[0]))
        keep = max(depth, 1)
        state.update((all_days[-keep:].tolist(), *[values[f][-keep:].tolist() for f in _FIELDS]))
        yield pd.DataFrame({"ts_code": key[0], "date": pd.to_datetime(all_days[hit], unit="D").date, "value": got[hit]})

    return bars.groupBy("ts_code").applyInPandasWithState(step, "ts_code string, date date, value double", _STATE, "append", GroupStateTimeout.NoTimeout)
