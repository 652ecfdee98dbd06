"""Null and zero defaults, unit factors and rounding.

Quantities and prices stay exact decimals up to the output edge: sums do not depend
on the order of the rows, and rounding is half away from zero.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO_IS_ONE = "one"
ZERO_IS_ZERO = "zero"

# A net quantity of 24 digits times a factor of 13 digits is exactly 38 digits wide,
# so the product keeps all eight decimals.
NET_QTY = "decimal(24,4)"
FACTOR = "decimal(13,4)"
RUNNING = "decimal(36,8)"


def or_default(value: Column, default) -> Column:
    """``default`` when the value is null or zero."""
    return F.when(value != 0, value).otherwise(F.lit(default))


def unit_factor(jumlah: Column, zero: str = ZERO_IS_ONE) -> Column:
    """Factor to the smallest unit: 1 for an unregistered unit or a null factor.

    A factor of zero counts as 1 (``one``) or stays zero (``zero``).
    """
    if zero == ZERO_IS_ONE:
        factor = F.when(jumlah != 0, jumlah).otherwise(F.lit(1))
    else:
        factor = F.coalesce(jumlah, F.lit(1))
    return factor.cast(FACTOR)


def to_double(value: Column, places: int) -> Column:
    return F.round(value, places).cast("double")


def ratio(numerator: Column, denominator: Column, places: int) -> Column:
    """Quotient rounded half up; null or non-positive denominators are the caller's case.

    The quotient is fixed to a decimal before rounding so that the binary
    representation of a double does not decide a tie.
    """
    quotient = numerator.cast("double") / denominator.cast("double")
    return F.round(quotient.cast("decimal(24,6)"), places)
