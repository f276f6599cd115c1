"""Rounding to cents and decimals as array libraries do it (never the decimal half-up of ``round``)."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def cents_half_up(price: Column) -> Column:
    """Cents of a limit price: halves go up, a millionth of a cent of float error included."""
    return F.floor(price * F.lit(100.0) + F.lit(0.5) + F.lit(1e-6)).cast("double")


def cents(price: Column) -> Column:
    """Cents of a quoted price: the nearest, halves to even."""
    return F.rint(price * F.lit(100.0))


def decimals(x: Column, places: int) -> Column:
    """Scaled, rounded half to even and scaled back."""
    return F.rint(x * F.lit(10.0**places)) / F.lit(10.0**places)
