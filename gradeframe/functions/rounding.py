"""Rounding that agrees with IEEE round-half-even on the exact binary value."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Veltkamp splitting constant 2**27 + 1: cuts a double into two 26-bit halves so
# that the products below are exact.
_SPLIT = 134217729.0


def exact_round(value: Column, digits: int) -> Column:
    """Round ``value`` to ``digits`` decimals, judging ties on the binary value.

    ``bround`` judges ties on the shortest decimal text, so 2.675 (stored as
    2.67499…) would round up. Only values whose text ends in 5 one place after
    the cut are affected; for them the sign of ``value - tie`` is computed
    without rounding error. Pass a materialised column: it is used repeatedly.
    """
    scale = float(10 ** (digits + 1))
    size = F.abs(value)
    near = F.rint(size * scale)
    high = size * _SPLIT - (size * _SPLIT - size)
    gap = (high * scale - near) + (size - high) * scale
    is_tie = (near % 10 == 5) & (F.abs(gap) < 1e-3)
    up = (near + 5) / 10 / (scale / 10)
    down = (near - 5) / 10 / (scale / 10)
    settled = (
        F.when(gap > 0, up)
        .when(gap < 0, down)
        .otherwise(F.when(((near - 5) / 10) % 2 == 0, down).otherwise(up))
    )
    return F.when(is_tie, F.signum(value) * settled).otherwise(F.bround(value, digits))


def exact_sum(value: Column) -> Column:
    """Sum of doubles that does not depend on the order of the rows.

    Values are added as decimals of ten places; those a decimal cannot hold (nan,
    infinity, 1e18 and above) as doubles. Null where there is no value.
    """
    exact = value.try_cast("decimal(28,10)")
    whole, rest = F.sum(exact).cast("double"), F.sum(F.when(exact.isNull(), value))
    return F.coalesce(whole + rest, whole, rest)


def percent(part: Column, whole: Column) -> Column:
    """``100 * part / whole`` to one decimal, 0 when the whole is 0 or missing."""
    return F.coalesce(F.bround(F.try_divide(F.lit(100.0) * part, whole), 1), F.lit(0.0))


def clamp(value: Column, low, high) -> Column:
    """Limit ``value`` to ``[low, high]``; null stays null."""
    return F.when(value.isNotNull(), F.least(high, F.greatest(low, value)))


def float_text(x: Column) -> Column:
    """A double in the shortest digits that read back as it, an exponent only below 1e-4 or from 1e16 on."""
    size = F.abs(x)
    digits = F.regexp_replace(F.when(size < 1e16, x).cast("decimal(38,20)").cast("string"), "0+$", "")
    plain = F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)
    java = F.split(x.cast("string"), "E")
    power = F.get(java, F.lit(1))
    sign = F.when(power.startswith("-"), "-").otherwise("+")
    places = F.replace(power, F.lit("-"), F.lit(""))
    padded = F.when(F.length(places) < 2, F.lpad(places, 2, "0")).otherwise(places)
    exponent = F.concat(F.regexp_replace(F.get(java, F.lit(0)), r"\.0$", ""), F.lit("e"), sign, padded)
    return (
        F.when(F.isnan(x), "nan").when(size == float("inf"), F.when(x > 0, "inf").otherwise("-inf"))
        .when((size >= 1e-4) & (size < 1e16), plain).when(size == 0, x.cast("string")).otherwise(exponent)
    )
