"""Event studies: one-price boards with a pullback, pullbacks after a strong day, halvings."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.functions.rounding import cents
from tapeloom.operators.bars import series, backward_adjusted, full_when, numbered, rows_between
from tapeloom.operators.limits import limit_features
from tapeloom.operators.returns import monthly_momentum

PRIOR_BARS = 63


def true(x):
    """A comparison with a missing value is false."""
    return F.coalesce(x, F.lit(False))


def one_price_pullbacks(bars: DataFrame, start: str, month_cap: float = 0.5, over_low: float = 1.2, reach: float | None = None) -> DataFrame:
    """Signals after a one-price limit-up: the first of the two next bars that closes below it.

    The board day (D0) is one-price up to a cent, at a limit, on no new listing, with no limit-up in the
    three bars before, and at most ``over_low`` times the lowest low of the 63 bars before; month returns at
    the signal are at most ``month_cap``. All features see the whole history; ``start`` filters last.
    """
    df = monthly_momentum(backward_adjusted(limit_features(bars, reach)))
    o, h, lo, c = (cents(F.col(x)) for x in ("open", "high", "low", "close"))
    like = (h - lo <= 1) & (c - o <= 1) & (c - lo <= 1)
    df = df.withColumn("one_price_up", like & F.col("any_limit_up") & ~F.col("new_stock"))
    df = df.withColumns({
        "d0": F.col("one_price_up") & (F.col("limit_ups_prev3") == 0),
        "prior_63_low": full_when(PRIOR_BARS, F.min("hfq_low"), rows_between(-PRIOR_BARS, -1)),
        "pct": F.col("hfq_close") / F.lag("hfq_close").over(series()) - 1,
        "five_only": true(F.col("close_c") == F.col("up5_c")) & ~true(F.col("close_c") == F.col("up_c")),
    })
    kept = F.struct("d0", "date", "close", "hfq_close", "prior_63_low", (F.col("one_price_up") & F.col("five_only")).alias("st_like"), "any_limit_up")
    df = df.withColumns({"p1": F.lag(kept, 1).over(series()), "p2": F.lag(kept, 2).over(series())})
    first = true(F.col("p1.d0")) & true(F.col("hfq_close") < F.col("p1.hfq_close"))
    second = true(F.col("p2.d0")) & ~true(F.col("p1.hfq_close") < F.col("p2.hfq_close")) & true(F.col("hfq_close") < F.col("p2.hfq_close"))
    low = lambda p: true(F.col(f"{p}.hfq_close") <= over_low * F.col(f"{p}.prior_63_low"))
    calm = true(F.col("current_month_return") <= month_cap) & true(F.col("prev_month_return") <= month_cap)
    hit = df.filter(((first & low("p1")) | (second & low("p2"))) & calm & (F.col("date") >= F.lit(start).cast("date")))
    hit = hit.withColumns({"gap_bars": F.when(first, 1).otherwise(2), "base": F.when(first, F.col("p1")).otherwise(F.col("p2"))})
    d1 = F.when(F.col("gap_bars") == 1, F.struct(F.col("date").alias("date"), F.col("close").alias("close"), F.col("hfq_close").alias("hfq_close"), F.col("any_limit_up").alias("up")))
    d1 = d1.otherwise(F.struct(F.col("p1.date").alias("date"), F.col("p1.close").alias("close"), F.col("p1.hfq_close").alias("hfq_close"), F.col("p1.any_limit_up").alias("up")))
    hit = hit.withColumn("d1", d1)
    d1_return = F.col("d1.hfq_close") / F.col("base.hfq_close") - 1
    return hit.select(
        "ts_code", F.col("date").alias("signal_date"), F.col("base.date").alias("board_date"), F.col("d1.date").alias("d1_date"), "gap_bars", "board", F.col("base.st_like").alias("st_like"),
        F.col("base.close").alias("board_close"), F.col("d1.close").alias("d1_close"), "close", d1_return.alias("d1_return"), (F.col("hfq_close") / F.col("base.hfq_close") - 1).alias("drop_pct"),
        F.col("pct").alias("signal_day_pct"), F.col("d1.up").alias("d1_limit_up"), "current_month_return", "prev_month_return", F.col("base.prior_63_low").alias("prior_63_low"),
        F.when(d1_return < 0, "down").when(d1_return > 0, "up").otherwise("flat").alias("d1_direction"), F.year("date").alias("year"),
    )


def strong_day_pullbacks(bars: DataFrame, start: str, jump: float = 1.09, longest: int = 7) -> DataFrame:
    """Quiet bars 1 to ``longest`` bars after the latest close more than ``jump`` times the one before.

    All bars since then together stay within fixed bounds of the strong close (highest high, lowest low
    above half the jump, mean, lowest and last close), and none falls 5 per cent from the close before or
    from its open. The strong bar opens a run; running aggregates within it say so in one more sort.
    """
    prev = F.lag("close").over(series())
    df = numbered(bars).withColumns({"prev": prev, "pct": F.col("close") * F.col("adj_factor") / (prev * F.lag("adj_factor").over(series())) - 1})
    strong = F.col("close") / F.col("prev") > jump
    mark = F.when(strong, F.struct("bar_no", "date", "close", F.col("prev").alias("pre")))
    df = df.withColumn("base", F.last(mark, ignorenulls=True).over(series().rowsBetween(W.unboundedPreceding, 0)))
    df = df.filter(F.col("base").isNotNull()).withColumns({"t": F.col("bar_no") - F.col("base.bar_no"), "run": F.col("base.bar_no")})
    df = df.filter(F.col("t").between(1, longest))
    since = W.partitionBy("ts_code", "run").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    bad = (F.col("close") / F.col("prev") <= 0.95) | (F.col("close") / F.col("open") <= 0.95)
    df = df.withColumns({"top": F.max("high").over(since), "bottom": F.min("low").over(since), "mean": F.avg("close").over(since), "least": F.min("close").over(since), "bad": F.sum(bad.cast("int")).over(since)})
    c, pre = F.col("base.close"), F.col("base.pre")
    quiet = (F.col("top") <= c * 1.08) & (F.col("bottom") >= pre + (c - pre) * 0.5) & (F.col("mean") >= c * 0.98) & (F.col("least") >= c * 0.96) & (F.col("close") >= c * 0.97) & (F.col("bad") == 0)
    hit = df.filter(quiet & (F.col("date") >= F.lit(start).cast("date")))
    return hit.select(
        "ts_code", F.col("date").alias("signal_date"), F.col("base.date").alias("strong_date"), "t", c.alias("strong_close"), (c / pre - 1).alias("strong_return"), F.col("close").alias("signal_close"),
        F.col("pct").alias("signal_day_pct"), (F.col("close") / c - 1).alias("pullback_pct"), (F.col("mean") / c - 1).alias("center_ratio"), (F.col("top") / c - 1).alias("high_ratio"), (F.col("bottom") / c - 1).alias("low_ratio"),
        F.when(F.col("pct") < 0, "down").when(F.col("pct") > 0, "up").otherwise("flat").alias("signal_direction"), F.year("date").alias("year"),
    )


def spaced(df: DataFrame, key: str, number: str, gap: int) -> DataFrame:
    """Greedy thinning: a row stays if it is at least ``gap`` numbers behind the last one that stayed.

    A fold over each key's sorted numbers (events of one key only, which are few and at most its bars)."""
    start = F.struct(F.lit(-(2**62)).cast("long").alias("last"), F.expr("cast(array() as array<bigint>)").alias("kept"))
    step = lambda s, x: F.when(x - s["last"] >= gap, F.struct(x.alias("last"), F.concat(s["kept"], F.array(x)).alias("kept"))).otherwise(s)
    kept = df.groupBy(key).agg(F.array_sort(F.collect_set(F.col(number).cast("long"))).alias("at"))
    kept = kept.select(key, F.explode(F.aggregate("at", start, step)["kept"]).alias(number))
    return df.join(kept, [key, number], "left_semi")


def halvings(bars: DataFrame, window: int = 63, horizon: int = 25, long_window: int = 504) -> DataFrame:
    """First closes below half the highest close of the ``window`` bars before, at least ``window`` bars apart,
    with the best high and the last close of the next ``horizon`` bars (null unless all are there)."""
    df = backward_adjusted(numbered(bars))
    before = rows_between(-window, -1)
    df = df.withColumn("long_high", full_when(long_window, F.max("hfq_close"), rows_between(-long_window, -1)))
    peak = F.max(F.struct(F.col("hfq_close").alias("v"), (-F.col("bar_no")).alias("n"), F.col("date").alias("d"), F.col("long_high").alias("high")))
    df = df.withColumn("peak", full_when(window, peak, before))
    df = df.withColumn("drawdown", F.col("hfq_close") / F.col("peak.v") - 1)
    last = F.lag("drawdown").over(series())
    best = full_when(horizon, F.max(F.struct(F.col("hfq_high").alias("v"), (-F.col("bar_no")).alias("n"), F.col("date").alias("d"))), rows_between(1, horizon))
    df = df.withColumns({"crossed": (F.col("drawdown") < -0.5) & (last.isNull() | (last >= -0.5)), "best": best, "end_close": F.lead("hfq_close", horizon).over(series()), "end_date": F.lead("date", horizon).over(series())})
    hit = spaced(df.filter("crossed"), "ts_code", "bar_no", window)
    return hit.select(
        "ts_code", F.col("date").alias("signal_date"), F.col("peak.d").alias("peak_date"), F.col("peak.v").alias("peak_close"), F.col("hfq_close").alias("signal_close"), (F.col("bar_no") + F.col("peak.n")).alias("peak_to_signal_bars"), "drawdown",
        "end_date", (F.col("end_close") / F.col("hfq_close") - 1).alias("terminal_return"), F.col("best.d").alias("best_date"), (F.col("best.v") / F.col("hfq_close") - 1).alias("best_return"),
        F.coalesce(F.col("peak.v") > F.col("peak.high"), F.lit(False)).alias("peak_is_long_high"), F.when(F.col("best").isNotNull(), "complete").otherwise("no_complete_window").alias("status"),
    )


def limit_downs_after(bars: DataFrame, starts: DataFrame, days: int = 3) -> DataFrame:
    """Starts (ts_code, date) with the dates, in order, on which the next ``days`` bars closed at the lower limit;
    an empty array if none did. Starts without a bar drop out."""
    df = limit_features(bars)
    each = [F.struct(F.lead("date", k).over(series()).alias("day"), F.lead("any_limit_down", k).over(series()).alias("down")) for k in range(1, days + 1)]
    df = df.select("ts_code", "date", F.array(*each).alias("next"))
    downs = F.transform(F.filter("next", lambda x: F.coalesce(x["down"], F.lit(False))), lambda x: x["day"])
    return df.join(starts.select("ts_code", "date").distinct(), ["ts_code", "date"], "left_semi").select("ts_code", "date", downs.alias("limit_downs"))
