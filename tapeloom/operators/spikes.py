"""Implausible readings of a source, relative to that source's own normal behaviour.

Per source, the daily profiles (a day's readings beside the close, the day's average price, the neighbouring
days' prices, and the step of the factor, as logarithms around the day's centre and in units of the usual
daily range) form a matrix. Robust principal components separate its low-rank part, the normal behaviour, from
a sparse one. A spike of any field is an entry of the sparse part; the check behind it only says which of the
day's readings it is. Constant runs and impossible values are tested separately.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.robust import robust_components, rolling_median, row_median, spread
from tapeloom.operators.current import current_bars

FIELDS = ("open", "high", "low", "adj_factor")
FOUND = pa.schema([("ts_code", pa.string()), ("date", pa.date32()), ("field", pa.string()), ("reason", pa.string()), ("value", pa.float64()), ("score", pa.float64())])


@dataclass(frozen=True)
class SpikeRules:
    """``block_days`` and ``margin_days`` bound what one task sees of a source: its bars of a block and their
    neighbours, at most one bar a day. ``cut`` is the sparse threshold in units of the source's usual daily
    range, ``night`` times that for the prices of the neighbouring days, ``run`` the least length of a constant stretch and ``chance`` the expected number of stretches
    of that length by chance that is still too small to be one. ``factor_step`` is the relative deviation
    from both neighbours that makes a factor an outlier, and ``factor_run`` the most bars that a wrong factor
    stands for; they lie within ``margin_days``, so every block sees the whole of them."""

    block_days: int = 2922
    margin_days: int = 120
    rank: int = 2
    cut: float = 2.2
    night: float = 2.0
    run: int = 6
    chance: float = 0.01
    factor_step: float = 0.05
    factor_run: int = 20


def _shift(x: np.ndarray, by: int) -> np.ndarray:
    out = np.full_like(x, np.nan)
    if by > 0:
        out[by:] = x[:-by]
    else:
        out[:by] = x[-by:]
    return out


def _near(x: np.ndarray, step: int) -> np.ndarray:
    """The nearest earlier (step 1) or later (step -1) value that isn't NaN."""
    y = x[::step]
    at = np.maximum.accumulate(np.where(np.isnan(y), 0, np.arange(len(y))))
    return _shift(y[at][::step], step)


def _stuck(x: np.ndarray, moved: np.ndarray, rules: SpikeRules) -> np.ndarray:
    """Marks the later bars of a stretch of one value, NaNs passed over, that is too long to be chance."""
    at = np.flatnonzero(~np.isnan(x) & moved)
    out = np.zeros(len(x), bool)
    if len(at) < rules.run:
        return out
    v = x[at]
    start = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    length = np.diff(np.concatenate([start, [len(v)]]))
    short = length < rules.run
    again = float(np.sum(length[short] - 1) + 1) / float(np.sum(length[short]) + 2)
    long = ~short & (len(v) * again ** np.minimum(length - 1, 60) < rules.chance)
    for s, n in zip(start[long], length[long], strict=True):
        out[at[s + 1 : s + n]] = True
    return out


def _excursions(day: np.ndarray, factor: np.ndarray, close: np.ndarray, steps: np.ndarray, rules: SpikeRules) -> np.ndarray:
    """How far the bars of short excursions are from the level around them, 0 elsewhere. ``factor`` and ``close``
    are logarithms, ``steps`` marks the bars at which the factor leaves the level before in the sparse part.

    An excursion lies above or below the factors on both sides, the bars at its sides carry on without it (the
    same level, or a step that the close takes the other way), and the closes inside fit the level of a side
    better than their own. At the ends of the series there is one side, and the step must be a large one."""
    score = np.zeros(len(factor))
    at = np.flatnonzero(~np.isnan(factor))
    if len(at) < 2:
        return score
    f, days = factor[at], day[at]
    c = np.where(np.isnan(close), _near(close, 1), close)[at]
    c = np.nan_to_num(np.where(np.isnan(c), _near(close, -1)[at], c))
    bounds = np.concatenate([[0], np.flatnonzero(steps[at][1:]) + 1, [len(f)]])
    last = len(bounds) - 1
    if last < 2:
        return score

    def fits(i: int, j: int) -> bool:
        gap = f[j] - f[i]
        return abs(gap) <= rules.factor_step or abs(gap + c[j] - c[i]) < 0.5 * abs(gap)

    def short(s: int, e: int) -> bool:
        return e - s <= rules.factor_run and days[min(e, len(f) - 1)] - days[max(s - 1, 0)] <= rules.margin_days

    k = 1
    while k < last:
        s, i = bounds[k], bounds[k] - 1
        for j in range(k + 1, last):
            e = bounds[j]
            if not short(s, e):
                break
            inside, sides = f[s:e], (f[i], f[e])
            off = np.maximum(min(sides) - inside, inside - max(sides))
            around = bounds[k] - bounds[k - 1] + bounds[j + 1] - e
            level = 0.5 * (f[i] + c[i] + f[e] + c[e])
            price = c[s:e] - level
            own, other = np.median(np.abs(inside + price)), min(np.median(np.abs(x + price)) for x in sides)
            same_side = (inside > max(sides)).all() or (inside < min(sides)).all()
            if same_side and off.min() > rules.factor_step and (around > e - s or e - s == 1) and fits(i, e) and own > other:
                score[at[s:e]] = off
                k = j
                break
        k += 1
    for s, e, i, j in ((0, bounds[1], bounds[1], bounds[1] - 1), (bounds[-2], len(f), bounds[-2] - 1, bounds[-2])):
        step, move = f[j] - f[i], c[j] - c[i]
        if short(s, e) and 2 * (e - s) < len(f) and not score[at[i]] and abs(step) > 0.2 and abs(step + move) > abs(move) + 0.15:
            score[at[s:e]] = np.abs(f[s:e] - f[i])
    return score


def _log(x: np.ndarray) -> np.ndarray:
    return np.log(np.where((x > 0) & np.isfinite(x), x, np.nan))


def faulty_readings(day: np.ndarray, price: dict[str, np.ndarray], rules: SpikeRules) -> list[tuple[str, str, np.ndarray, np.ndarray]]:
    """(field, reason, mask, score) of one source's bars in date order. ``price`` has open, high, low, close,
    vol, amount and adj_factor as doubles with NaN for no value."""
    raw = {k: price[k] for k in ("open", "high", "low", "close", "vol", "amount", "adj_factor")}
    n = len(day)
    found = []
    traded = ~(raw["vol"] == 0)
    flat = (raw["open"] == raw["high"]) & (raw["high"] == raw["low"]) & (raw["low"] == raw["close"])
    use = {}
    none = np.zeros(n)

    # Impossible alone.
    for f in FIELDS:
        bad = (raw[f] <= 0) | np.isinf(raw[f])
        found.append((f, "impossible", bad, np.where(bad, np.inf, 0.0)))
        use[f] = np.where(bad, np.nan, raw[f])
    close = np.where(raw["close"] > 0, raw["close"], np.nan)

    # Constant stretches: the value repeats from bar to bar while trading goes on and other prices move.
    for f in ("open", "high", "low"):
        bad = _stuck(use[f], traded & ~flat, rules)
        found.append((f, "stuck", bad, bad * 1.0))
        use[f] = np.where(bad, np.nan, use[f])

    # Daily profiles: logarithms around the day's centre in units of the usual daily range. The prices of the
    # neighbouring days are carried to this day's factor; the last column is the factor's own step.
    factor = _log(use["adj_factor"])
    o, h, lo, c = (_log(x) for x in (use["open"], use["high"], use["low"], close))
    mean = _log(np.where(traded & (raw["vol"] > 0), raw["amount"] / raw["vol"], np.nan))
    day_range = np.where(traded & ~flat & (h > lo), h - lo, np.nan)
    usual = spread(day_range, 1e-3) / 1.4826
    local = rolling_median(day_range, 30)
    scale = np.maximum(np.where(np.isnan(local), usual, np.maximum(local, 0.5 * usual)), 1e-3)
    cut = rules.cut * np.array([1.0, 1.0, 1.0, 1.0, 1.0, rules.night, rules.night, 1.0])

    def separate(level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        before, after = _near(c + level, 1) - level, _near(o + level, -1) - level
        bar = np.stack([o, h, lo, c, mean], axis=1)
        centre = row_median(np.where(np.isnan(bar).all(axis=1)[:, None], np.stack([before, after, before, after, before], axis=1), bar))
        steady = np.stack([o, c, mean, before, after], axis=1)
        size = np.fmax(scale, 2.0 * row_median(np.abs(steady - row_median(steady)[:, None])))
        profile = np.concatenate([bar - centre[:, None], np.stack([before - centre, after - centre, level - _near(level, 1)], axis=1)], axis=1) / size[:, None]
        return profile, *robust_components(profile, rules.rank, cut), before, after

    # Factors: a step of the sparse part that the prices don't take is the edge of an excursion if the factor
    # returns from it. A genuine step leaves the price before, carried to its factor, where the low-rank part has it.
    _, _, sparse, _, _ = separate(factor)
    unexplained = (sparse[:, 7] != 0) & (np.sign(sparse[:, 5]) == -np.sign(sparse[:, 7]))
    left = _excursions(day, factor, _log(close), unexplained, rules)
    found.append(("adj_factor", "spike", left > 0, left))
    level = np.where(left > 0, np.nan, factor)
    level = np.where(np.isnan(level), np.where(np.isnan(_near(level, 1)), _near(level, -1), _near(level, 1)), level)
    m, low_rank, sparse, before, after = separate(np.nan_to_num(level))

    # High and low exchanged: both readings are wrong.
    top, floor = np.fmax(o, c), np.fmin(o, c)
    swapped = traded & (h < lo - 1e-9) & ~(h > floor + 1e-9) & ~(lo < top - 1e-9) & ~np.isnan(top)
    for f, j in (("high", 1), ("low", 2)):
        found.append((f, "swapped", swapped, np.where(swapped, np.abs(m[:, j]), 0.0)))
    h, lo = np.where(swapped, lo, h), np.where(swapped, h, lo)

    # Sparse entries of the readings: the reading itself is off if it lies on that side of all other prices of the bar.
    over = {"open": (o, 0, np.fmax(np.fmax(h, lo), c), np.fmin(np.fmin(h, lo), c)), "high": (h, 1, np.fmax(np.fmax(o, lo), c), None), "low": (lo, 2, None, np.fmin(np.fmin(o, h), c))}
    kept = {"open": o, "high": h, "low": lo}
    for f, (x, j, upper, lower) in over.items():
        beyond = np.zeros(n, bool)
        if upper is not None:
            beyond |= (sparse[:, j] > 0) & (x > upper + 1e-9)
        if lower is not None:
            beyond |= (sparse[:, j] < 0) & (x < lower - 1e-9)
        bad = traded & ~swapped & beyond
        found.append((f, "spike", bad, np.where(bad, np.abs(sparse[:, j]), 0.0)))
        kept[f] = np.where(bad, np.nan, x)
    o, h, lo = kept["open"], kept["high"], kept["low"]

    # Impossible beside the others: the one reading without which the bar is consistent; of two such, the
    # one further from the low-rank profile.
    def broken(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
        eps = 1e-9
        return (a > b + eps) | (a < d - eps) | (c > b + eps) | (c < d - eps) | (d > b + eps)

    nan = np.full(n, np.nan)
    wrong = traded & broken(o, h, lo)
    away = np.abs(m - low_rank)
    fits = np.stack([~broken(nan, h, lo), ~broken(o, nan, lo), ~broken(o, h, nan)], axis=1)
    judged = np.where(fits, away[:, :3], -1.0)
    worst = np.argmax(np.where(fits.any(axis=1)[:, None], judged, away[:, :3]), axis=1)
    for j, f in enumerate(("open", "high", "low")):
        bad = wrong & (worst == j)
        found.append((f, "out_of_bar", bad, np.where(bad, away[:, j], none)))
    return found


def _kernel(rules: SpikeRules):
    def find(table: pa.Table) -> pa.Table:
        table = table.sort_by("day")
        col = {k: table[k].to_numpy() for k in ("day", "own")}
        price = {k: table[k].to_numpy().astype(float) for k in ("open", "high", "low", "close", "vol", "amount", "adj_factor")}
        code = table["ts_code"][0].as_py()
        at, fields, reasons, values, scores = [], [], [], [], []
        with np.errstate(invalid="ignore", divide="ignore"):
            for field, reason, mask, score in faulty_readings(col["day"], price, rules):
                hit = np.flatnonzero(mask & col["own"])
                at.append(hit)
                fields += [field] * len(hit)
                reasons += [reason] * len(hit)
                values.append(price[field][hit])
                scores.append(score[hit])
        at = np.concatenate(at)
        days = pa.array(col["day"][at].astype(np.int32), pa.int32()).cast(pa.date32())
        return pa.table([pa.array([code] * len(at), pa.string()), days, pa.array(fields, pa.string()), pa.array(reasons, pa.string()), pa.array(np.concatenate(values)), pa.array(np.concatenate(scores))], schema=FOUND)

    return find


def implausible_readings(bars: DataFrame, rules: SpikeRules = SpikeRules()) -> DataFrame:
    """Faulty readings of ``bars`` (unique by ts_code and date): ts_code, date, field, reason, value, score.

    A reading may be named for several reasons. Null and NaN readings are never faults and don't disturb
    the others; bars with ``vol`` 0 and one-price bars are no evidence for or against a price. Sources with
    few bars are judged by those; an empty table gives none. Other columns are ignored.

    A task sees one source and block of days, and its neighbours within the margin: at most
    ``block_days + 2 * margin_days`` bars, however many deliveries the source had.
    """
    day = F.unix_date(F.col("date"))
    rows = bars.select("ts_code", day.alias("day"), "open", "high", "low", "close", F.col("vol").cast("double").alias("vol"), "amount", "adj_factor")
    size, margin = F.lit(rules.block_days), F.lit(rules.margin_days)
    home = F.floor(F.col("day") / size)
    blocks = F.array_distinct(F.array(home, F.floor((F.col("day") - margin) / size), F.floor((F.col("day") + margin) / size)))
    rows = rows.select("*", home.alias("home"), F.explode(blocks).alias("block"))
    rows = rows.withColumn("own", F.col("home") == F.col("block")).drop("home")
    kernel = _kernel(rules)
    return rows.groupBy("ts_code", "block").applyInArrow(kernel, "ts_code string, date date, field string, reason string, value double, score double")


def faulty_bar_readings(stock_daily: DataFrame, rules: SpikeRules = SpikeRules()) -> DataFrame:
    """:func:`implausible_readings` of the current bars."""
    return implausible_readings(current_bars(stock_daily), rules)
