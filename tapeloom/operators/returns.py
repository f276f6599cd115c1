"""Returns: the market index, forward returns, path returns and monthly momentum."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.operators.bars import before_now, full_when, rows_between, series
from tapeloom.operators.small import checked_broadcast


def market_index(bars: DataFrame) -> DataFrame:
    """date, close_idx, open_idx: the compounded equal-weight mean of the instruments' daily and overnight
    returns. ``bars`` has hfq_open and hfq_close. The running product is over days, one row each, not bars."""
    before = F.lag("hfq_close").over(series())
    moves = bars.select("date", (F.col("hfq_close") / before - 1).alias("r"), (F.col("hfq_open") / before - 1).alias("night"))
    daily = moves.groupBy("date").agg(F.avg("r").alias("r"), F.avg("night").alias("night"), F.count("r").alias("n"))
    days = W.orderBy("date")
    daily = daily.withColumn("close_idx", F.product(1 + F.coalesce("r", F.lit(0.0))).over(days.rowsBetween(W.unboundedPreceding, 0)))
    open_idx = F.coalesce(F.lag("close_idx").over(days), F.lit(1.0)) * (1 + F.coalesce("night", F.lit(0.0)))
    return daily.withColumn("open_idx", open_idx).select("date", "close_idx", "open_idx", "n")


def forward_returns(bars: DataFrame, index: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """Per bar and horizon: ret_close, ex_close, ret_open, ex_open and whether the entry is blocked.

    Close entries buy at this close, open entries at the next open; both sell at the close ``horizon`` bars
    ahead and have no value without it. Excess is over the market on the same dates. The index is joined by date
    once, before the windows, and looks ahead with the bars; it is broadcast only if its days are few. ``bars``: limit
    features and hfq prices.
    """
    blocked = F.lead(F.col("is_one_price") & F.col("any_limit_up")).over(series())
    days = checked_broadcast(index.select("date", "close_idx", "open_idx"))
    df = bars.select("ts_code", "date", "hfq_open", "hfq_close", "is_one_price", "any_limit_up").join(days, "date", "left")
    ends = [F.struct(F.lit(h).alias("horizon"), F.lead("hfq_close", h).over(series()).alias("exit_close"), F.lead("close_idx", h).over(series()).alias("m1")) for h in horizons]
    ahead = [F.lead(c).over(series()).alias(name) for c, name in (("hfq_open", "next_open"), ("open_idx", "mo"))]
    df = df.select("ts_code", "date", "hfq_close", F.col("close_idx").alias("m0"), *ahead, F.coalesce(blocked, F.lit(False)).alias("entry_blocked"), F.array(*ends).alias("ends"))
    df = df.select("ts_code", "date", "hfq_close", "m0", "next_open", "mo", "entry_blocked", F.inline("ends"))
    ret_close, ret_open = F.col("exit_close") / F.col("hfq_close") - 1, F.col("exit_close") / F.col("next_open") - 1
    return df.select(
        "ts_code", "date", "horizon", "entry_blocked", ret_close.alias("ret_close"), (ret_close - (F.col("m1") / F.col("m0") - 1)).alias("ex_close"),
        ret_open.alias("ret_open"), (ret_open - (F.col("m1") / F.col("mo") - 1)).alias("ex_open"),
    )


def best_close_ahead(bars: DataFrame, horizon: int = 25, price: str = "hfq_close") -> DataFrame:
    """Adds best_close, best_date (the first of equal ones), end_date and best_return over the next ``horizon``
    bars, null unless all of them are there."""
    frame = rows_between(1, horizon)
    top = full_when(horizon, F.max(F.struct(F.col(price).alias("v"), (-F.unix_date("date")).alias("d"))), frame)
    df = bars.withColumns({"_top": top, "end_date": F.lead("date", horizon).over(series())})
    day = F.date_from_unix_date(-F.col("_top.d"))
    return df.withColumns({"best_close": F.col("_top.v"), "best_date": day, "best_return": F.col("_top.v") / F.col("hfq_close") - 1}).drop("_top")


def lowest_bar_path(bars: DataFrame, signal_gap: str, horizon: int = 25) -> DataFrame:
    """Path from the lowest-low bar of the three after the start to the best close after it.

    ``bars`` are the start bars' whole series with ``signal_gap`` (1 to 3) on starts, null elsewhere. Entry is
    the close of the first lowest low among the next three bars; a start whose entry lies before the
    signal, or without ``horizon`` further bars, has no path.
    """
    low = [F.lead("hfq_low", k).over(series()) for k in (1, 2, 3)]
    best = [F.max(F.struct(F.col("hfq_close").alias("v"), (-F.unix_date("date")).alias("d"))).over(rows_between(k + 1, k + horizon)) for k in (1, 2, 3)]
    close = [F.lead("hfq_close", k).over(series()) for k in (1, 2, 3)]
    day = [F.lead("date", k).over(series()) for k in (1, 2, 3)]
    end = [F.lead("date", k + horizon).over(series()) for k in (1, 2, 3)]
    packed = F.array(*[F.struct(low[i].alias("low"), close[i].alias("close"), day[i].alias("day"), best[i].alias("best"), end[i].alias("end")) for i in range(3)])
    starts = bars.select("ts_code", "date", signal_gap, packed.alias("ways")).filter(F.col(signal_gap).isNotNull())
    least = F.array_min(F.transform("ways", lambda w: w["low"]))
    whole = F.forall("ways", lambda w: w["low"].isNotNull())
    entry = F.when(whole, F.array_position(F.transform("ways", lambda w: w["low"]), least).cast("int"))
    df = starts.withColumn("entry", entry).filter(F.col("entry") >= F.col(signal_gap)).withColumn("way", F.element_at("ways", F.col("entry"))).filter(F.col("way.end").isNotNull())
    return df.select(
        "ts_code", "date", "entry", F.col("way.day").alias("entry_date"), F.col("way.close").alias("entry_close"), F.date_from_unix_date(-F.col("way.best.d")).alias("exit_date"),
        F.col("way.best.v").alias("exit_close"), F.col("way.end").alias("horizon_date"), (F.col("way.best.v") / F.col("way.close") - 1).alias("path_return"),
    )


def monthly_momentum(bars: DataFrame) -> DataFrame:
    """Adds prev_month_return (between the closes of the two months with bars before this one) and
    current_month_return (this close against the last close of the month before).

    The last bar of a month is the one whose next is of another; its close, and the one that it looks back on, are
    carried forward over the same partitioning and sort as the other windows."""
    month = F.trunc("date", "MM")
    ends = F.coalesce(F.lead(month).over(series()) != month, F.lit(False))
    df = bars.withColumn("_end", F.when(ends, F.col("hfq_close")))
    df = df.withColumn("_base", F.last("_end", ignorenulls=True).over(before_now()))
    df = df.withColumn("_base2", F.last(F.when(F.col("_end").isNotNull(), F.struct("_base")), ignorenulls=True).over(before_now())["_base"])
    return df.withColumns({"prev_month_return": F.col("_base") / F.col("_base2") - 1, "current_month_return": F.col("hfq_close") / F.col("_base") - 1}).drop("_end", "_base", "_base2")
