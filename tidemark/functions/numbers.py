"""Rounding and ratios with one stated rule each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_to(x: Column, places: int) -> Column:
    """Half away from zero at ``places``, on the scaled double."""
    scale = 10.0 ** places
    return F.round(x.cast("double") * F.lit(scale)) / F.lit(scale)


def safe_ratio(a: Column, b: Column, scale: float = 1.0) -> Column:
    """a / b × scale as double; 0 where b is 0 or null."""
    return F.when(b != 0, a.cast("double") / b.cast("double") * F.lit(float(scale))).otherwise(F.lit(0.0))


def sanitize(x: Column) -> Column:
    """NaN, infinities and nulls become 0."""
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(x)


def fixed(x: Column, places: int) -> Column:
    """printf %.nf with ties to even, where format_string alone rounds ties up."""
    return F.format_string(f"%.{places}f", F.bround(x, places))


def percent_change(current: Column, previous: Column) -> Column:
    """(current / previous − 1) × 100 to one decimal, null without a previous value."""
    return F.when(previous != 0, round_to((current / previous - 1) * 100, 1))


def difference(current: Column, previous: Column) -> tuple[Column, Column]:
    """How far the larger value exceeds the smaller, in percent to one decimal, and the direction:
    ``positive``, ``negative`` or ``neutral``. No previous value gives neither; equal values or a
    zero divisor give a direction only."""
    high, low = F.greatest(current, previous), F.least(current, previous)
    diff = F.when((current != previous) & (low != 0), round_to((high / low - 1) * 100, 1))
    state = (F.when(current > previous, F.lit("positive")).when(current < previous, F.lit("negative"))
             .when(current == previous, F.lit("neutral")))
    return diff, state
