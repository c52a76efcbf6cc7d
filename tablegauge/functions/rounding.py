"""Half-to-even rounding that agrees with the two roundings the published numbers use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Powers of two that add up to 2 * 10**digits: multiplying by each is exact in binary.
_EXACT_PARTS = {0: (2,), 1: (16, 4), 2: (128, 64, 8)}


def round_exact(value: Column, digits: int = 0) -> Column:
    """Round the exact binary value of a double, ties to even (as Python's ``round``).

    ``bround`` works on the shortest decimal text, so 62.45 counts as a tie there
    although the stored value lies above it. Here the distance to the midpoint is
    computed without rounding error.
    """
    scale = float(10**digits)
    v = F.abs(value.cast("double"))
    low = F.floor(v * scale).cast("double")
    gap = low * 2 + 1
    for part in _EXACT_PARTS[digits]:
        gap = gap - v * float(part)
    up = (gap < 0) | ((gap == 0) & (low % 2 == 1))
    rounded = (low + F.when(up, 1.0).otherwise(0.0)) / scale
    # Beyond 2**45 a double has too few fraction bits for the step above to matter.
    rounded = F.when(v < float(2**45), rounded).otherwise(F.bround(v, digits))
    return F.when(value < 0, -rounded).otherwise(rounded)


def round_scaled(value: Column, digits: int = 0) -> Column:
    """Scale, round to the nearest whole number with ties to even, scale back (as numpy)."""
    if digits == 0:
        return F.rint(value)
    scale = float(10**digits)
    return F.rint(value * scale) / scale


def percent(value: Column) -> Column:
    """Share to whole percent."""
    return round_scaled(value * 100).cast("bigint")


def ratio(part: Column, whole: Column) -> Column:
    """Quotient of two counts; NULL when there is nothing to divide by."""
    return F.try_divide(part.cast("double"), whole.cast("double"))
