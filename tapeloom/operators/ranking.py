"""Ranking studies over date intervals."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.operators.bars import before_now, series


def amount_leaders(bars: DataFrame, start: str, end: str, min_days: int, top: int) -> DataFrame:
    """The ``top`` instruments by average daily amount in an interval: rank, days, coverage and amounts.

    Bars without an amount or with a negative one don't count. Coverage is against the days on which any
    instrument has such a bar. ValueError for an empty interval or counts below one.
    """
    if end < start or min_days <= 0 or top <= 0:
        raise ValueError("end before start, or min_days or top not above 0")
    rows = bars.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")) & (F.col("amount") >= 0))
    days = rows.agg(F.countDistinct("date").alias("market_days"))
    per = rows.groupBy("ts_code").agg(F.countDistinct("date").alias("trading_days"), F.sum("amount").alias("total_amount"), F.avg("amount").alias("average_daily_amount"), F.max("amount").alias("max_daily_amount"))
    best = per.filter(F.col("trading_days") >= min_days).orderBy(F.col("average_daily_amount").desc(), F.col("trading_days").desc(), "ts_code").limit(top)
    by = W.orderBy(F.col("average_daily_amount").desc(), F.col("trading_days").desc(), "ts_code")
    # One row of days is joined to at most ``top`` rows.
    best = best.join(F.broadcast(days.withColumn("_one", F.lit(1))), F.col("_one") == F.lit(1)).drop("_one")
    return best.withColumns({"rank": F.row_number().over(by), "coverage": F.col("trading_days") / F.col("market_days")})


def holding_returns(bars: DataFrame, start: str, end: str) -> DataFrame:
    """Return from the first to the last bar of an interval per instrument: dates, closes, days, return,
    annualized (from 365 days on), highs and lows with the first date of each, and whether it has both ends.

    ``bars`` has hfq_close, hfq_high and hfq_low. One aggregation; first and last are by date.
    """
    rows = bars.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    day = F.unix_date("date")
    df = rows.groupBy("ts_code").agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.min_by("hfq_close", "date").alias("first_close"), F.max_by("hfq_close", "date").alias("last_close"),
        F.max(F.struct("hfq_high", (-day).alias("d"))).alias("high"), F.min(F.struct("hfq_low", day.alias("d"))).alias("low"), F.count("*").alias("bars"),
    )
    total = F.col("last_close") / F.col("first_close") - 1
    days = F.datediff("last_date", "first_date")
    annual = F.when(days >= 365, F.pow(1 + total, F.lit(365.25) / days) - 1)
    return df.select(
        "ts_code", "first_date", "last_date", "first_close", "last_close", days.alias("days"), total.alias("total_return"), annual.alias("annualized"), F.col("high.hfq_high").alias("high"), F.date_from_unix_date(-F.col("high.d")).alias("high_date"),
        F.col("low.hfq_low").alias("low"), F.date_from_unix_date(F.col("low.d")).alias("low_date"), "bars",
    )


def endpoint_returns(bars: DataFrame, start: str, end: str, top: int) -> DataFrame:
    """The ``top`` instruments by return between two dates, of those with a bar on both; rank from 1."""
    ends = bars.filter(F.col("date").isin(F.lit(start).cast("date"), F.lit(end).cast("date")))
    at = lambda d: F.max(F.when(F.col("date") == F.lit(d).cast("date"), F.col("hfq_close")))
    df = ends.groupBy("ts_code").agg(at(start).alias("start_close"), at(end).alias("end_close")).filter((F.col("start_close") > 0) & (F.col("end_close") > 0))
    df = df.withColumn("total_return", F.col("end_close") / F.col("start_close") - 1)
    best = df.orderBy(F.col("total_return").desc(), "ts_code").limit(top)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.col("total_return").desc(), "ts_code")))


def run_ups(bars: DataFrame, start: str, end: str) -> DataFrame:
    """Largest rise from a low to a later bar's high per instrument in an interval, with both dates.

    The low is strictly before the high; of equal lows the last, of equal rises the first counts.
    """
    rows = bars.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    rows = rows.withColumn("low_before", F.min("hfq_low").over(before_now()))
    is_low = F.col("hfq_low") <= F.coalesce(F.col("low_before"), F.col("hfq_low"))
    rows = rows.withColumn("low_date", F.last(F.when(is_low, F.col("date")), ignorenulls=True).over(before_now()))
    rise = F.col("hfq_high") / F.col("low_before") - 1
    top = rows.withColumn("rise", rise).filter("rise is not null").groupBy("ts_code").agg(F.max(F.struct("rise", (-F.unix_date("date")).alias("d"), "low_date", F.col("low_before").alias("low"), F.col("hfq_high").alias("high"))).alias("top"))
    return top.select("ts_code", F.col("top.rise").alias("run_up"), F.col("top.low_date").alias("low_date"), F.date_from_unix_date(-F.col("top.d")).alias("high_date"), F.col("top.low").alias("low"), F.col("top.high").alias("high"))


def drawdowns(curve: DataFrame, day: str, level: str) -> DataFrame:
    """One row for a curve (a row per day): total, annualized and the largest drawdown with its date."""
    days = W.orderBy(day)
    df = curve.select(F.col(day).alias("day"), F.col(level).alias("level"), (F.col(level) / F.max(level).over(days.rowsBetween(W.unboundedPreceding, 0)) - 1).alias("dd"))
    one = df.agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.min_by("level", "day").alias("a"), F.max_by("level", "day").alias("z"), F.min(F.struct("dd", "day")).alias("worst"))
    total = F.col("z") / F.col("a") - 1
    years = F.datediff("last_day", "first_day") / F.lit(365.25)
    return one.select("first_day", "last_day", total.alias("total_return"), F.when(years > 0, F.pow(1 + total, 1 / years) - 1).alias("annualized"), F.col("worst.dd").alias("max_drawdown"), F.col("worst.day").alias("max_drawdown_day"))


def panel(returns: DataFrame, full_from: str) -> DataFrame:
    """Mean, median, share of rises and median annualized return of four overlapping groups."""
    full = F.col("first_date") <= F.lit(full_from).cast("date")
    groups = F.array(F.lit("all"), F.when(full, "full_period"), F.when(~full, "later"), F.when(F.col("annualized").isNotNull(), "a_year_or_more"))
    df = returns.select("*", F.explode(F.filter(groups, lambda g: g.isNotNull())).alias("group"))
    r = F.col("total_return")
    return df.groupBy("group").agg(F.count("*").alias("n"), F.avg(r).alias("mean"), F.median(r).alias("median"), F.avg((r > 0).cast("double")).alias("up_share"), F.median("annualized").alias("median_annualized"))


def deciles(returns: DataFrame, value: str) -> DataFrame:
    """decile 10..90 and its exact value."""
    at = [q / 10 for q in range(1, 10)]
    both = F.arrays_zip(F.array(*[F.lit(int(q * 100 + 0.5)) for q in at]).alias("decile"), F.percentile(F.col(value), F.array(*[F.lit(q) for q in at])).alias("value"))
    return returns.agg(both.alias("x")).select(F.inline("x").alias("decile", "value"))


def holding_status(returns: DataFrame, start: str) -> DataFrame:
    """Adds full_period (a first bar within ten days of ``start`` and a last one on the interval's last day) and status, for
    :func:`holding_returns`. The last day is one row, joined by equality."""
    one = F.lit(1).alias("_one")
    last = returns.agg(F.max("last_date").alias("_end")).select("_end", one)
    df = returns.withColumn("_one", F.lit(1)).join(F.broadcast(last), "_one")
    alive = F.col("last_date") == F.col("_end")
    whole = alive & (F.col("first_date") <= F.date_add(F.lit(start).cast("date"), 10))
    return df.withColumns({"full_period": whole, "status": F.when(alive, "trading").otherwise("delisted_or_suspended")}).drop("_one", "_end")


def winners(run_ups: DataFrame, group: str, thresholds: dict[str, float]) -> DataFrame:
    """Per threshold and group: stocks, how many rose by more than the threshold, their share of all that did and of the
    group, and their median, mean and highest rise. Groups are few (boards, industries), so the totals are a window over them."""
    each = F.array(*[F.struct(F.lit(name).alias("threshold"), F.lit(x).alias("_least")) for name, x in thresholds.items()])
    rows = run_ups.select("*", F.inline(each)).withColumn("_won", F.when(F.col("run_up") > F.col("_least"), F.col("run_up")))
    won = rows.groupBy("threshold", group).agg(F.count("*").alias("stocks"), F.count("_won").alias("over"), F.median("_won").alias("median_rise"), F.avg("_won").alias("mean_rise"), F.max("_won").alias("highest_rise"))
    total = F.sum("over").over(W.partitionBy("threshold"))
    return won.withColumns({"share_of_winners": F.try_divide(F.col("over"), total), "share_of_group": F.col("over") / F.col("stocks")})
