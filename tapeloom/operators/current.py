"""Current rows: of several deliveries of one key, the latest."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.codes import as_number, canonical_code

BAR_VALUES = ("open", "high", "low", "close", "vol", "amount", "adj_factor")


def micros(at: Column, kind: str) -> Column:
    """Microseconds of a timestamp, with a zone or without one, since 1970 on its own clock."""
    if kind == "timestamp":
        return F.unix_micros(at)
    day = F.unix_date(at.cast("date")).cast("long")
    if kind == "date":
        return day * F.lit(86_400_000_000)
    second = (F.extract(F.lit("SECOND"), at) * F.lit(1_000_000)).cast("long")
    return ((day * F.lit(24) + F.hour(at)) * F.lit(60) + F.minute(at)) * F.lit(60_000_000) + second


def current_rows(df: DataFrame, keys: Sequence[str], version: str, columns: Sequence[str]) -> DataFrame:
    """One row per key: ``columns`` of the row with the greatest ``version`` (a timestamp or date).

    Keys must not be null (callers drop such rows before they rewrite keys, so that the filter reaches the
    scan); a null version is older than any other; of rows that tie, one is taken whole, for every
    aggregate compares the same versions in the same order. The buffers have a fixed width, so this is a
    hash aggregation without sorting: repeats are combined before the shuffle, and the shuffle is on the
    whole key, so a source that is delivered millions of times is spread over all its keys' partitions.
    """
    age = F.coalesce(F.col(version), F.lit("0001-01-01 00:00:00").cast(dict(df.dtypes)[version]))
    return df.groupBy(*keys).agg(*[F.max_by(F.col(c), age).alias(c) for c in columns])


def _numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.withColumns({c: as_number(F.col(c)) for c in columns if kinds[c] in ("double", "float")})


def current_bars(stock_daily: DataFrame, columns: Sequence[str] = BAR_VALUES) -> DataFrame:
    """Current bars by canonical ``ts_code`` and ``date``; NaN becomes null in the value columns."""
    known = stock_daily.dropna(subset=["ts_code", "date"])
    rows = known.select(canonical_code(F.col("ts_code")).alias("ts_code"), "date", "synced_at", *columns)
    return _numbers(current_rows(rows, ("ts_code", "date"), "synced_at", columns), columns)


def current_events(yizi_events: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Current events by canonical ``ts_code`` and ``signal_date``; NaN becomes null in the value columns."""
    known = yizi_events.dropna(subset=["ts_code", "signal_date"])
    rows = known.select(canonical_code(F.col("ts_code")).alias("ts_code"), "signal_date", "loaded_at", *columns)
    return _numbers(current_rows(rows, ("ts_code", "signal_date"), "loaded_at", columns), columns)
