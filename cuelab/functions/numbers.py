"""Rounding of doubles by their exact binary value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Beyond so many digits the exact fractions no longer fit into decimals of 38 digits.
MOST_DIGITS = 12


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used there."""
    return F.get(F.transform(F.array(value), body), 0)


def _power_of_two(k: Column) -> Column:
    """2^k as a whole number, for k up to 124: beyond 2^62 no integer holds it, and a double's digits would be lost."""
    one, half = F.lit(1).cast("bigint"), F.floor(k / 2).cast("int")
    parts = [F.call_function("shiftleft", one, n).cast("decimal(19,0)") for n in (half, k - half)]
    return parts[0] * parts[1]


def round_half_even(value: Column, digits: int) -> Column:
    """The double next to ``value`` rounded to ``digits`` decimals, as Python's ``round`` gives it.

    ``F.round`` and ``F.bround`` round the shortest decimal that prints the same (0.0005 counts as a tie, though the
    double lies above it). Here the double is taken apart, value = m / 2^k with whole numbers m and k, and
    m * 10^digits is divided by 2^k without loss; only true ties go to the even digit. Infinite values, NaN and NULL stay.
    """
    if not 0 <= digits <= MOST_DIGITS:
        raise ValueError(f"digits must be 0 to {MOST_DIGITS}")
    scale, two = 10.0**digits, F.lit(2.0)

    def exponent(size: Column) -> Column:
        # m has at most 54 bits; log2 may be off by one next to a power of two, which costs a bit only
        return (F.lit(53) - F.floor(F.log2(size))).cast("int")

    def fraction(size: Column, k: Column) -> Column:
        half = F.floor(k / 2).cast("int")
        m = size * F.pow(two, half.cast("double")) * F.pow(two, (k - half).cast("double"))  # without loss
        return F.struct((m.cast("decimal(19,0)") * F.lit(10**digits).cast("decimal(13,0)")).alias("top"), _power_of_two(k).alias("below"))

    def nearest(t: Column) -> Column:
        top, below = t["top"], t["below"]

        def with_rest(whole: Column) -> Column:
            rest = 2 * (top - whole.cast("decimal(19,0)") * below)
            up = lambda r: F.when(r > below, 1).when(r < below, 0).otherwise(whole % 2)
            return (whole + _let(rest, up)).cast("double") / scale

        return _let(F.call_function("div", top, below), with_rest)

    def rounded(x: Column) -> Column:
        size = F.abs(x)
        found = _let(exponent(size), lambda k: _let(fraction(size, k), nearest))
        # from 2^53 on neighbouring doubles are at least one unit of the last digit apart
        stays = x.isNull() | F.isnan(x) | (size * scale >= 2.0**53)
        return F.when(stays, x).when(size * scale < 0.25, x * 0.0).otherwise(F.when(x < 0, -1.0).otherwise(1.0) * found)

    return _let(value.cast("double"), rounded)
