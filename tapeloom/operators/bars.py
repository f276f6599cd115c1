"""Bars: valid ones, their numbers, adjusted prices, resampling, averages and windows around a date."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.functions.rounding import decimals

PRICES = ("open", "high", "low", "close")


def series():
    """The series of one instrument in date order."""
    return W.partitionBy("ts_code").orderBy("date")


def rows_between(first: int, last: int):
    """The instrument's bars from ``first`` to ``last`` relative to the current one."""
    return series().rowsBetween(first, last)


def up_to_now():
    return rows_between(W.unboundedPreceding, 0)


def before_now():
    return rows_between(W.unboundedPreceding, -1)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def valid_bars(bars: DataFrame, columns: Sequence[str] = (*PRICES, "adj_factor")) -> DataFrame:
    """Bars whose ``columns`` are all finite and positive."""
    for c in columns:
        bars = bars.filter(finite(F.col(c)) & (F.col(c) > 0))
    return bars


def full_when(n: int, value: Column, frame) -> Column:
    """An aggregate over ``frame`` that needs all its ``n`` rows, null before."""
    return F.when(F.count(F.lit(1)).over(frame) == n, value.over(frame))


def numbered(bars: DataFrame) -> DataFrame:
    """``bar_no``: the bar's place in the instrument's whole history, from 0."""
    return bars.withColumn("bar_no", F.row_number().over(series()) - 1)


def backward_adjusted(bars: DataFrame) -> DataFrame:
    """``hfq_*`` prices: the quoted ones times the factor."""
    return bars.withColumns({f"hfq_{p}": F.col(p) * F.col("adj_factor") for p in PRICES})


def forward_adjusted_view(bars: DataFrame) -> DataFrame:
    """Prices relative to the instrument's last factor, to four decimals; vol and amount stay."""
    last = F.last("adj_factor").over(series().rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return bars.withColumn("_last", last).withColumns({p: decimals(F.col(p) * F.col("adj_factor") / F.col("_last"), 4) for p in PRICES}).drop("_last", "adj_factor")


def period_end(date: Column, period: str) -> Column:
    """Label of the week (its Friday) or the month (its last day) that has the date."""
    return F.next_day(F.date_sub(date, 1), "FRI") if period == "W" else F.last_day(date)


def resample(bars: DataFrame, period: str) -> DataFrame:
    """One bar per instrument and period ``W`` or ``M``: first open, extremes, last close, sums.

    First and last are by date, in one hash aggregation with a partial step; periods without bars have no
    row; null vol or amount count as 0."""
    total = [F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in ("vol", "amount")]
    return bars.groupBy("ts_code", period_end(F.col("date"), period).alias("date")).agg(
        F.min_by("open", "date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "date").alias("close"), *total, F.count("*").alias("bars")
    )


def moving_averages(bars: DataFrame, lengths: Sequence[int] = (5, 10, 20)) -> DataFrame:
    """``ma<n>`` of close over the last n bars, null until there are n."""
    return bars.withColumns({f"ma{n}": full_when(n, F.avg("close"), rows_between(1 - n, 0)) for n in lengths})


def around(bars: DataFrame, targets: DataFrame, before: int, after: int) -> DataFrame:
    """The bars from ``before`` bars ahead of each target (ts_code, date) to ``after`` bars behind it.

    Targets without a bar on their date give nothing; windows are cut at the ends of the series."""
    known = numbered(bars)
    days = targets.select(F.col("ts_code").alias("_code"), F.col("date").alias("target_date")).distinct()
    at = known.join(days, (F.col("ts_code") == F.col("_code")) & (F.col("date") == F.col("target_date"))).select("_code", "target_date", F.col("bar_no").alias("_at"))
    wanted = at.select("_code", "target_date", F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("offset"), "_at")
    return known.join(wanted, (F.col("ts_code") == F.col("_code")) & (F.col("bar_no") == F.col("_at") + F.col("offset"))).drop("_code", "_at")


def overlapping(bars: DataFrame, first: str, last: str, period: str) -> DataFrame:
    """Period bars whose days overlap the dates from ``first`` to ``last``."""
    start = F.date_sub("date", 6) if period == "W" else F.trunc("date", "MM")
    return bars.filter((start <= F.lit(last).cast("date")) & (F.col("date") >= F.lit(first).cast("date")))
