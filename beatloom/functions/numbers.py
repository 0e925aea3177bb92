"""Column helpers for numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def real(c: Column) -> Column:
    """The value, null where it is NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def six(c: Column, name: str) -> Column:
    """The value with six decimals (never -0.0), null where it is no real number."""
    return (F.round(real(c.cast("double")), 6) + F.lit(0.0)).alias(name)


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, null where ``b`` is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def half_even(c: Column, places: int = 0) -> Column:
    """Rounding in which halves go to the even neighbour."""
    return F.bround(c, places)
