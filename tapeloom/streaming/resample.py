"""Weekly bars of a stream of daily bars, with late bars up to a bound."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weekly_stream(bars: DataFrame, late: str = "7 days") -> DataFrame:
    """Weekly bars (labelled by Friday) in append mode: a week comes out when the watermark passes its end.

    Bars later than ``late`` behind the newest one are dropped by the watermark. State is one row per
    instrument and open week."""
    day = F.col("date").cast("timestamp")
    week = F.window("at", "7 days", "7 days", "2 days")  # weeks start on Saturday; day 0 was a Thursday
    merged = bars.withColumn("at", day).withWatermark("at", late).groupBy("ts_code", week.alias("week")).agg(
        F.min_by("open", "at").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "at").alias("close"), F.sum(F.coalesce("vol", F.lit(0))).alias("vol"), F.count("*").alias("bars")
    )
    return merged.select("ts_code", F.date_sub(F.col("week.end").cast("date"), 1).alias("date"), "open", "high", "low", "close", "vol", "bars")
