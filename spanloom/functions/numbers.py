"""Rounding of doubles by their exact binary values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Splits a double into two halves whose products are exact.
_SPLIT = float(2**27 + 1)
#: From here on a double has no fraction.
_WHOLE = float(2**52)


def _halves(x: Column) -> tuple[Column, Column]:
    high = x * _SPLIT - (x * _SPLIT - x)
    return high, x - high


def half_even(x: Column, places: int) -> Column:
    """x to so many decimal places, as its exact value says and to the even digit in a tie, which is what Python's round gives.

    The product with the power of ten is taken as a double and the exact error of it (Dekker's product), so
    a value that only seems to lie half way goes to its own side. Values too large to have so many
    places, infinities, NaN and null stay as they are.
    """
    ten = float(10**places)
    b_high = ten * _SPLIT - (ten * _SPLIT - ten)
    b_low = ten - b_high

    def of(v: Column) -> Column:
        high, low = _halves(v)
        p = v * ten
        error = ((high * b_high - p) + high * b_low + low * b_high) + low * b_low
        floor = F.floor(p).cast("double")
        # Twice what is left over one half: its sign decides.
        rest = (p - floor - 0.5) + error
        odd = F.pmod(floor, F.lit(2.0)) == 1
        rounded = floor + F.when((rest > 0) | ((rest == 0) & odd), 1.0).otherwise(0.0)
        made = F.when(rounded == 0, v * 0.0).otherwise(rounded / ten)  # a nought keeps its sign
        return F.when(F.abs(v) * ten < _WHOLE, made).otherwise(v)

    return let(x.cast("double"), of)
