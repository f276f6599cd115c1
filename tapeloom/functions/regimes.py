"""Market regimes: alternating intervals of dates."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The first day of every regime, in order; the first one has no beginning.
REGIMES = (("0001-01-01", "bear"), ("2019-02-01", "bull"), ("2021-11-30", "bear"), ("2024-09-23", "bull"), ("2026-07-01", "bear"))


def regime_number(date: Column) -> Column:
    """Number of the interval that holds the date, from 0; null for null."""
    return sum((F.when(date >= F.lit(start).cast("date"), 1).otherwise(0) for start, _ in REGIMES[1:]), F.when(date.isNotNull(), F.lit(0)))


def regime(date: Column) -> Column:
    """``bull`` or ``bear``. Neighbouring intervals differ, so the number's parity says which."""
    return F.when(regime_number(date) % 2 == 1, "bull").when(date.isNotNull(), "bear")


def regime_of_span(first: Column, last: Column) -> Column:
    """The regime of a span whose ends lie in one interval, else ``cross``; no day is enumerated."""
    return F.when(regime_number(first) == regime_number(last), regime(first)).when(first.isNotNull() & last.isNotNull(), "cross")
