"""Audits: invalid rows, coverage against the calendar, gaps, and reconciliation of two tables."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.functions.codes import exchange_of
from tapeloom.operators.bars import PRICES, finite


def invalid_rows(bars: DataFrame) -> DataFrame:
    """One row: how many rows each predicate marks. A row may be marked by several; keys repeat if a row with
    the same key comes before it."""
    number = lambda c: finite(F.col(c))
    every = number("open") & number("high") & number("low") & number("close")
    marks = {
        "nonfinite_price": ~every,
        "nonpositive_price": F.greatest(*[F.when(number(p) & (F.col(p) <= 0), 1).otherwise(0) for p in PRICES]) == 1,
        "low_above_high": every & (F.col("low") > F.col("high")),
        "open_outside": every & ((F.col("open") > F.col("high")) | (F.col("open") < F.col("low"))),
        "close_outside": every & ((F.col("close") > F.col("high")) | (F.col("close") < F.col("low"))),
        "bad_factor": ~(number("adj_factor") & (F.col("adj_factor") > 0)),
        "negative_flow": (F.col("vol") < 0) | (number("amount") & (F.col("amount") < 0)),
    }
    sums = [F.count_if(F.coalesce(m, F.lit(False))).alias(k) for k, m in marks.items()]
    keyed = bars.groupBy("ts_code", "date").agg(F.count("*").alias("n"), *sums)
    return keyed.agg(F.sum("n").alias("rows"), *[F.sum(k).alias(k) for k in marks], F.sum(F.col("n") - 1).alias("repeated_keys"))


def sessions(trade_calendar: DataFrame) -> DataFrame:
    """exchange, date and its number among the exchange's sessions."""
    opened = F.array(*[F.struct(F.lit(x).alias("exchange"), F.col(f"{x.lower()}_open").alias("is_open")) for x in ("SH", "SZ", "BJ")])
    days = trade_calendar.select(F.col("cal_date").alias("date"), F.inline(opened)).filter("is_open").select("exchange", "date").distinct()
    return days.withColumn("session", F.row_number().over(W.partitionBy("exchange").orderBy("date")))


def coverage(bars: DataFrame, trade_calendar: DataFrame) -> DataFrame:
    """Per instrument: first and last session with a bar, bars on sessions and off them, sessions between, the
    missing ones, runs of missing ones and the longest. The calendar has a row per day and is broadcast."""
    numbered = F.broadcast(sessions(trade_calendar))
    placed = bars.select("ts_code", exchange_of(F.col("ts_code")).alias("exchange"), "date").join(numbered, ["exchange", "date"], "left")
    order = W.partitionBy("ts_code").orderBy("session")
    on = placed.filter("session is not null").withColumn("gap", F.col("session") - F.lag("session").over(order) - 1)
    per = on.groupBy("ts_code").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("bars"), (F.max("session") - F.min("session") + 1).alias("sessions"), F.count_if(F.col("gap") > 0).alias("gap_runs"), F.coalesce(F.max("gap"), F.lit(0)).alias("longest_gap"))
    off = placed.filter("session is null").groupBy("ts_code").agg(F.count("*").alias("off_calendar"))
    return per.join(off, "ts_code", "left").select("*", (F.col("sessions") - F.col("bars")).alias("missing")).withColumn("off_calendar", F.coalesce("off_calendar", F.lit(0).cast("long")))


def gaps(bars: DataFrame, trade_calendar: DataFrame) -> DataFrame:
    """Every run of missing sessions: ts_code, the bars around it and its length."""
    numbered = F.broadcast(sessions(trade_calendar))
    on = bars.select("ts_code", exchange_of(F.col("ts_code")).alias("exchange"), "date").join(numbered, ["exchange", "date"])
    order = W.partitionBy("ts_code").orderBy("session")
    df = on.select("ts_code", F.lag("date").over(order).alias("after"), F.col("date").alias("before"), (F.col("session") - F.lag("session").over(order) - 1).alias("sessions"))
    return df.filter("sessions > 0")


def daily_counts(bars: DataFrame) -> DataFrame:
    return bars.groupBy("date").agg(F.countDistinct("ts_code").alias("instruments"), F.count_if(F.col("vol") == 0).alias("without_trading"))


def yearly_coverage(bars: DataFrame) -> DataFrame:
    """Per year: sessions, bars, and the instruments on its first and last day."""
    daily = bars.groupBy("date").agg(F.count("*").alias("n"))
    return daily.groupBy(F.year("date").alias("year")).agg(F.count("*").alias("days"), F.sum("n").alias("bars"), F.min_by("n", "date").alias("first_day_instruments"), F.max_by("n", "date").alias("last_day_instruments"))


def inventory(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of two tables with their rows and where they are: ``both``, ``left_only`` or ``right_only``."""
    a, b = left.groupBy(key).agg(F.count("*").alias("left_rows")), right.groupBy(key).agg(F.count("*").alias("right_rows"))
    where = F.when(F.col("left_rows").isNull(), "right_only").when(F.col("right_rows").isNull(), "left_only").otherwise("both")
    return a.join(b, key, "full").select(key, "left_rows", "right_rows", where.alias("where"))


def missing_instruments(master: DataFrame, bars: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Master rows without any bar under their code or the one that succeeded it, flagged."""
    codes = bars.select("ts_code").distinct()
    pairs = [(k, v) for k, v in (aliases or {}).items()]
    named = master.sparkSession.createDataFrame(pairs, "ts_code string, successor string")
    lost = master.join(codes, "ts_code", "left_anti").join(F.broadcast(named), "ts_code", "left")
    there = codes.select(F.col("ts_code").alias("successor"), F.lit(True).alias("successor_present"))
    return lost.join(there, "successor", "left").withColumn("successor_present", F.coalesce("successor_present", F.lit(False)))


def reconcile_adjusted(bars: DataFrame, adjusted: DataFrame, tolerance: float) -> DataFrame:
    """One row: keys in both tables, on either side only, and how many prices differ by more than ``tolerance``.

    ``bars`` are adjusted by the caller; both are unique by ts_code and date."""
    a = bars.select("ts_code", "date", *[F.col(p).alias(f"a_{p}") for p in PRICES])
    b = adjusted.select("ts_code", "date", *[F.col(p).alias(f"b_{p}") for p in PRICES])
    both = a.join(b.withColumn("_b", F.lit(True)), ["ts_code", "date"], "full").withColumn("_a", F.col("a_open").isNotNull() | F.col("a_close").isNotNull())
    off = [F.count_if(F.abs(F.col(f"a_{p}") - F.col(f"b_{p}")) > tolerance).alias(f"{p}_off") for p in PRICES]
    return both.agg(F.count_if(F.col("_a") & F.col("_b").isNotNull()).alias("matched"), F.count_if(F.col("_b").isNull()).alias("left_only"), F.count_if(~F.col("_a")).alias("right_only"), *off)


def same_calendar(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Days that only one of two tables has, with the side; none if the calendars are equal."""
    a, b = left.select(column).distinct(), right.select(column).distinct()
    return a.subtract(b).withColumn("side", F.lit("left")).unionByName(b.subtract(a).withColumn("side", F.lit("right")))


def coverage_record(bars: DataFrame, copy: DataFrame, trade_calendar: DataFrame, basic: DataFrame, since: str) -> DataFrame:
    """Per instrument of ``bars`` (unique by ts_code and date), 15 fields: first and last day, bars, bars since a day, whether
    the deliveries came in date order, whether the second system has the instrument, how many rows, the same days and the
    same vol and amount, missing sessions and the longest gap since that day, the listing date and how long after it the bars begin.

    ``bars`` has ``delivered`` (a timestamp). Days and flows are compared in one full join by the whole key."""
    b = bars.select("ts_code", "date", "vol", "amount", "delivered")
    other = copy.select("ts_code", "date", F.col("vol").alias("c_vol"), F.col("amount").alias("c_amount"), F.lit(True).alias("there"))
    both = b.withColumn("here", F.lit(True)).join(other, ["ts_code", "date"], "full")
    same = F.col("vol").eqNullSafe(F.col("c_vol")) & F.col("amount").eqNullSafe(F.col("c_amount"))
    paired = both.groupBy("ts_code").agg(
        F.count("here").alias("bars"), F.count("there").alias("copy_rows"), F.min(F.when(F.col("here"), F.col("date"))).alias("first_date"), F.max(F.when(F.col("here"), F.col("date"))).alias("last_date"),
        F.count_if(F.col("here") & (F.col("date") >= F.lit(since).cast("date"))).alias("bars_since"), F.count_if(F.col("here").isNull() | F.col("there").isNull()).alias("unpaired"), F.count_if(F.col("here") & F.col("there") & ~same).alias("different"),
    ).filter("bars > 0")
    order = W.partitionBy("ts_code").orderBy("date")
    late = b.withColumn("back", F.col("delivered") < F.lag("delivered").over(order)).groupBy("ts_code").agg((F.count_if("back") == 0).alias("date_order_ok"))
    gap = coverage(bars.filter(F.col("date") >= F.lit(since).cast("date")), trade_calendar).select("ts_code", "missing", "longest_gap")
    listed = basic.groupBy("ts_code").agg(F.min("list_date").alias("list_date"))
    out = paired.join(late, "ts_code").join(gap, "ts_code", "left").join(listed, "ts_code", "left")
    aligned = (F.col("copy_rows") > 0) & (F.col("unpaired") == 0)
    return out.select(
        "ts_code", "first_date", "last_date", "bars", "bars_since", "date_order_ok", (F.col("copy_rows") > 0).alias("copy_exists"), "copy_rows", aligned.alias("aligned"), (aligned & (F.col("different") == 0)).alias("values_equal"), "different",
        F.coalesce("missing", F.lit(0)).alias("missing_inside_span"), F.coalesce("longest_gap", F.lit(0)).alias("longest_internal_gap"), "list_date", F.datediff("first_date", "list_date").alias("start_gap_days"),
    )


def reconcile_rows(bars: DataFrame, adjusted: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """One row: whether both tables have equally many rows, keys on one side only, rows with a price further apart than
    ``tolerance`` (one without a value counts), and rows with other vol or amount."""
    a = bars.select("ts_code", "date", *[F.col(c).alias(f"a_{c}") for c in (*PRICES, "vol", "amount")], F.lit(True).alias("a"))
    b = adjusted.select("ts_code", "date", *[F.col(c).alias(f"b_{c}") for c in (*PRICES, "vol", "amount")], F.lit(True).alias("b"))
    both = a.join(b, ["ts_code", "date"], "full")
    pair = F.col("a") & F.col("b")
    bad = F.lit(False)
    for p in PRICES:
        bad = bad | F.coalesce(F.abs(F.col(f"a_{p}") - F.col(f"b_{p}")) > tolerance, ~F.col(f"a_{p}").eqNullSafe(F.col(f"b_{p}")))
    flow = ~(F.col("a_vol").eqNullSafe(F.col("b_vol")) & F.col("a_amount").eqNullSafe(F.col("b_amount")))
    return both.agg((F.count("a") == F.count("b")).alias("row_count_match"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("bad_key_rows"), F.count_if(pair & bad).alias("bad_price_rows"), F.count_if(pair & flow).alias("bad_flow_rows"))
