"""Irregular readings onto a regular grid, with gaps marked and filled by singular-spectrum imputation."""

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.functions.codes import as_number, exchange_of
from tapeloom.operators.bars import finite
from tapeloom.operators.current import current_bars
from tapeloom.operators.small import checked_broadcast


@dataclass(frozen=True)
class Imputation:
    """``choices`` are pairs of Hankel window and singular vectors kept; a block takes the first that gives back
    every ``held_out``-th of its own readings as well as the best, and the very first (whose fixed point is the straight
    line) for want of readings. ``tolerance`` is the change of any filled logarithm at which the iteration has converged. A
    task sees the ``block`` slots of one source and ``margin`` slots of context on either side."""

    choices: tuple[tuple[int, int], ...] = ((2, 1), (4, 2), (8, 3), (24, 5))
    held_out: int = 10
    tolerance: float = 1e-6
    iterations: int = 200
    block: int = 1024
    margin: int = 64


def _averaging(axes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Rows of the linear map that projects all windows of a series of ``n`` on ``axes`` and averages the
    results along the anti-diagonals, for the places ``at``: a column per distance from -(w-1) to w-1."""
    w = len(axes)
    projection = axes @ axes.T
    low, high = np.maximum(0, at - (n - w)), np.minimum(w - 1, at)
    rows = np.empty((len(at), 2 * w - 1))
    for d in range(1 - w, w):
        sums = np.zeros(w + 1)
        first, last = max(0, -d), min(w, w - d)
        sums[first + 1 : last + 1] = np.diagonal(projection, d)
        sums = np.cumsum(sums)
        rows[:, d + w - 1] = sums[high + 1] - sums[low]
    return rows / (high - low + 1)[:, None]


def singular_spectrum_fill(x: np.ndarray, missing: np.ndarray, embed: int, rank: int, tolerance: float = 1e-6, iterations: int = 200) -> tuple[np.ndarray, int, bool]:
    """``x`` with its ``missing`` entries (which hold a first guess) replaced until they stop changing, the rounds
    and whether they did within ``iterations``.

    The trajectory (Hankel) matrix of the series is projected on its leading singular vectors, taken from the
    small Gram matrix, and averaged along its anti-diagonals. For given vectors the missing entries that
    this leaves as they are solve a linear system, so a round replaces them by its solution instead of by one step
    towards it. A series too short to embed is returned as it is."""
    n, window = len(x), min(embed, len(x) // 2)
    at = np.flatnonzero(missing)
    if window < 2 or not len(at) or len(at) == n:
        return x, 0, True
    y = x - x[~missing].mean()
    place = np.full(n, -1)
    place[at] = np.arange(len(at))
    near = at[:, None] + np.arange(1 - window, window)[None]
    inside = (near >= 0) & (near < n)
    near = np.clip(near, 0, n - 1)
    unknown = inside & missing[near]
    rows, columns = np.nonzero(unknown)[0], place[near[unknown]]
    for step in range(1, iterations + 1):
        path = np.lib.stride_tricks.sliding_window_view(y, window)
        _, axes = np.linalg.eigh(path.T @ path)
        weights = _averaging(axes[:, -min(rank, window) :], at, n) * inside
        system = np.eye(len(at)) * (1.0 + 1e-9)
        np.subtract.at(system, (rows, columns), weights[unknown])
        fresh = np.linalg.solve(system, (weights * np.where(unknown, 0.0, y[near])).sum(axis=1) + 1e-9 * y[at])
        change = np.max(np.abs(fresh - y[at]))
        y[at] = fresh
        if change < tolerance:
            return y + x[~missing].mean(), step, True
    return y + x[~missing].mean(), iterations, False


def chosen_pair(x: np.ndarray, missing: np.ndarray, rules: Imputation) -> tuple[int, int]:
    """The first of ``rules.choices`` whose mean error on held-out readings is not above the least one's by more than a
    standard error of their difference."""
    known = np.flatnonzero(~missing)
    held = known[1:-1][:: rules.held_out]
    if len(rules.choices) == 1 or len(held) < 8:
        return rules.choices[0]
    hidden = missing.copy()
    hidden[held] = True
    left = np.flatnonzero(~hidden)
    guess = np.where(hidden, np.interp(np.arange(len(x)), left, x[left]), x)
    errors = np.stack([np.abs(singular_spectrum_fill(guess, hidden, *pair, rules.tolerance, 3)[0][held] - x[held]) for pair in rules.choices])
    worse = errors - errors[np.argmin(errors.mean(axis=1))]
    return rules.choices[int(np.argmax(worse.mean(axis=1) <= worse.std(axis=1) / np.sqrt(len(held))))]


_FILLED = "source string, calendar string, slot int, filled_value double, line_value double, rounds int, converged boolean"
_KINDS = (pa.string(), pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.bool_())


def _confirmed(value: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The running sum of those steps of ``level`` that ``value`` takes the other way; both are logarithms."""
    step, move = np.nan_to_num(np.diff(level)), np.diff(value)
    return np.concatenate([[0.0], np.cumsum(np.where(np.abs(step + move) < 0.5 * np.abs(step), step, 0.0))])


def _kernel(rules: Imputation):
    names = [x.split()[0] for x in _FILLED.split(", ")]

    def fill(spans: pa.Table, readings: pa.Table) -> pa.Table:
        nothing = pa.table([pa.array([], k) for k in _KINDS], names=names)
        if not spans.num_rows:
            return nothing
        span = {c: spans[c][0].as_py() for c in spans.column_names}
        readings = readings.sort_by("slot")
        slot, value, level = (readings[c].to_numpy(zero_copy_only=False).astype(float) for c in ("slot", "value", "level"))
        for end in ("before", "after"):
            beyond, late = span[end], end == "after"
            if beyond is not None and (not len(slot) or (beyond["slot"] > slot[-1] if late else beyond["slot"] < slot[0])):
                where = len(slot) if late else 0
                slot, value, level = (np.insert(a, where, np.nan if v is None else v) for a, v in ((slot, beyond["slot"]), (value, beyond["value"]), (level, beyond["level"])))
        low, high = max(span["part"] * rules.block - rules.margin, int(slot[0])), min((span["part"] + 1) * rules.block - 1 + rules.margin, int(slot[-1]))
        slots = np.arange(low, high + 1)
        at = np.searchsorted(slot, slots, side="right") - 1
        lost = slot[at] != slots
        own = (slots // rules.block == span["part"]) & lost
        if not own.any():
            return nothing
        logs = bool((value > 0).all())
        known = np.log(value) if logs else value
        steady = _confirmed(known, np.log(np.where(level > 0, level, np.nan))) if logs else np.zeros(len(known))
        carried = np.interp(slots, slot, steady)  # a step within a gap may be anywhere in it
        series = np.interp(slots, slot, known + steady)
        line = np.interp(slots, slot, known)
        filled, rounds, converged = singular_spectrum_fill(series, lost, *chosen_pair(series, lost, rules), rules.tolerance, rules.iterations)
        filled = filled - carried
        if logs:
            filled, line = np.exp(filled), np.exp(line)
        k = int(own.sum())
        columns = [[span["of"]] * k, [span["calendar"]] * k, slots[own].astype(np.int32), filled[own], line[own], np.full(k, rounds, np.int32), np.full(k, converged)]
        return pa.table([pa.array(c, kind) for c, kind in zip(columns, _KINDS, strict=True)], names=names)

    return fill


def bucketed(readings: DataFrame, period, value: str = "value", keys: Sequence[str] = ("source", "calendar")) -> DataFrame:
    """Readings at irregular times (``time``) put into the slot ``period`` (an expression of the time) that has
    them: the last of a slot's readings with a value, by time. Readings of a slot are combined before they are shuffled."""
    known = readings.withColumn("_value", as_number(F.col(value).cast("double"))).filter("_value is not null")
    return known.groupBy(*keys, period.alias("period")).agg(F.max_by("_value", "time").alias("value"))


def regular_grid(readings: DataFrame, slots: DataFrame, rules: Imputation = Imputation()) -> DataFrame:
    """A row per source and slot between the source's first and last reading.

    ``readings``: source, calendar, period, value and perhaps level, unique by source and period (see
    :func:`bucketed` for readings at irregular times); ``slots``: calendar and period of every regular slot.
    Readings without a value (null, NaN) or whose period is no slot of their calendar don't count. Result: source,
    period, value (null if missing), filled_value, is_filled, and of filled slots line_value (the straight line
    between the readings around the gap), rounds and converged. A slot between two readings is never
    dropped; a source with one reading has one row; empty inputs give none. Logarithms are used where all values of
    a block are positive; then steps of ``level`` that the values take the other way are taken out
    before the imputation and put back behind it.

    Readings are shuffled once, by source and block of slots, so no task sees a whole source. Gaps come from the
    readings of a block and the nearest ones of other blocks, which a table of a row per source and block
    knows; blocks that lie wholly in a gap have a row there too. Only slots to fill come back from the kernel.
    """
    order = W.partitionBy("calendar").orderBy("period")
    numbered = checked_broadcast(slots.select("calendar", "period").dropna().distinct().withColumn("slot", F.row_number().over(order)))
    level = F.col("level").cast("double") if "level" in readings.columns else F.lit(None).cast("double")
    known = readings.select("source", "calendar", "period", as_number(F.col("value").cast("double")).alias("value"), level.alias("level")).filter("value is not null")
    placed = known.join(numbered, ["calendar", "period"]).select("source", "calendar", "slot", "value", "level")
    size, margin = F.lit(rules.block), F.lit(rules.margin)
    block = F.floor(F.col("slot") / size)
    near = F.array_distinct(F.array(block, F.floor((F.col("slot") - margin) / size), F.floor((F.col("slot") + margin) / size)))
    spread = placed.select("source", F.explode(near).alias("block"), "slot", "value", "level")

    ends = {}
    for name, pick in (("first", F.min_by), ("last", F.max_by)):
        ends[name] = F.struct(pick("slot", "slot").alias("slot"), pick("value", "slot").alias("value"), pick("level", "slot").alias("level")).alias(name)
    per = placed.groupBy("source", "calendar", block.alias("block")).agg(*ends.values())
    along = W.partitionBy("source").orderBy("block")
    per = per.withColumns({"next_block": F.lead("block").over(along), "after": F.lead("first").over(along), "ahead": F.lag("last").over(along)})
    inner = F.when(F.col("next_block") > F.col("block") + 1, F.sequence(F.col("block") + 1, F.col("next_block") - 1)).otherwise(F.array().cast("array<bigint>"))
    rows = F.concat(F.array(F.struct(F.col("block").alias("part"), F.col("ahead").alias("before"), "after")), F.transform(inner, lambda b: F.struct(b.alias("part"), F.col("last").alias("before"), F.col("after").alias("after"))))
    spans = per.select(F.col("source").alias("of"), "calendar", F.inline(rows))

    filled = spans.groupBy("of", "part").cogroup(spread.groupBy("source", "block")).applyInArrow(_kernel(rules), _FILLED)
    kept = placed.select("source", "calendar", "slot", "value", F.col("value").alias("filled_value"), F.lit(False).alias("is_filled"))
    made = filled.select("source", "calendar", "slot", "filled_value", F.lit(True).alias("is_filled"), "line_value", "rounds", "converged")
    whole = kept.unionByName(made, allowMissingColumns=True).join(numbered, ["calendar", "slot"])
    return whole.select("source", "period", "value", "filled_value", "is_filled", "line_value", "rounds", "converged")


def sessions_of(trade_calendar: DataFrame) -> DataFrame:
    """calendar (SH, SZ, BJ) and period of every session."""
    open_on = F.array(*[F.struct(F.lit(x).alias("calendar"), F.col(f"{x.lower()}_open").alias("is_open")) for x in ("SH", "SZ", "BJ")])
    return trade_calendar.select(F.col("cal_date").alias("period"), F.inline(open_on)).filter("is_open").select("calendar", "period")


def close_readings(stock_daily: DataFrame) -> DataFrame:
    """The closes of the current bars as readings, with the factor as their level."""
    bars = current_bars(stock_daily, ("close", "adj_factor"))
    return bars.select(F.col("ts_code").alias("source"), exchange_of(F.col("ts_code")).alias("calendar"), F.col("date").alias("period"), F.col("close").alias("value"), F.col("adj_factor").alias("level"))


def session_closes(stock_daily: DataFrame, trade_calendar: DataFrame, rules: Imputation = Imputation()) -> DataFrame:
    """The series of close on every session of each code's exchange."""
    return regular_grid(close_readings(stock_daily), sessions_of(trade_calendar), rules)


def held_out_closes(stock_daily: DataFrame, trade_calendar: DataFrame, one_in: int = 20, rules: Imputation = Imputation()) -> DataFrame:
    """The series imputed after a share of the closes, by a hash of code and day, was hidden: source, period, value
    (the hidden close), filled_value and line_value of the hidden sessions that lie between two others."""
    readings = close_readings(stock_daily).filter(finite(F.col("value")) & (F.col("value") > 0))
    hidden = F.pmod(F.xxhash64("source", "period"), F.lit(one_in)) == 0
    filled = regular_grid(readings.filter(~hidden), sessions_of(trade_calendar), rules).filter("is_filled").drop("value")
    return filled.join(readings.filter(hidden).select("source", "period", "value"), ["source", "period"])


def weekly_closes(stock_daily: DataFrame, rules: Imputation = Imputation()) -> DataFrame:
    """The series of close on every week (its Monday) between each code's first and last: the last close of a week."""
    closes = close_readings(stock_daily).withColumnRenamed("period", "time").withColumn("calendar", F.lit("week"))
    readings = bucketed(closes, F.trunc("time", "week"))
    span = readings.agg(F.min("period").alias("a"), F.max("period").alias("z")).filter("a is not null")
    slots = span.select(F.lit("week").alias("calendar"), F.explode(F.sequence("a", "z", F.expr("interval 7 days"))).alias("period"))
    return regular_grid(readings, slots, rules)
