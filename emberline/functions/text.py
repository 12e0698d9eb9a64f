"""Text layouts shared by messages, alerts and reports."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(value: Column, digits: int) -> Column:
    """Fixed-point text, rounded from the number's exact binary value; ties go to the even digit, null stays null.

    Below 2^31 the number is turned into a whole multiple of 2^-63, which a decimal holds
    exactly, and compared with the half-way point. Larger ones are left to the formatter.
    """
    if digits < 1:
        raise ValueError("at least one digit")
    size, scale = F.abs(value.cast("double")), 10**digits
    shifted = size * F.lit(float(1 << 30))
    high = F.floor(shifted)
    low = F.floor((shifted - high.cast("double")) * F.lit(float(1 << 33)))
    exact = high.cast("decimal(20,0)") * F.lit(Decimal(1 << 33)) + low.cast("decimal(10,0)")
    whole = F.floor(size * F.lit(float(scale)))
    half = (whole * F.lit(2) + F.lit(1)).cast("decimal(18,0)") * F.lit(Decimal(1 << 63))
    doubled = exact * F.lit(Decimal(2 * scale))
    up = F.when(doubled > half, F.lit(1)).when(doubled == half, whole % 2).otherwise(F.lit(0))
    rounded = whole + up
    sign = F.when(value.cast("double") < 0, F.lit("-")).otherwise(F.lit(""))
    small = F.concat(sign, F.floor(rounded / F.lit(scale)).cast("string"), F.lit("."), F.lpad((rounded % scale).cast("string"), digits, "0"))
    text = F.when(size < F.lit(float(1 << 31)), small).otherwise(F.format_string(f"%.{digits}f", value.cast("double")))
    return F.when(value.isNotNull(), text)


def percent(share: Column, digits: int) -> Column:
    """A share as percentage text, 0.25 -> ``25.0%``."""
    return F.concat(fixed(share * F.lit(100.0), digits), F.lit("%"))


def grouped(count: Column) -> Column:
    """An integer with thousands separators; null stays null."""
    return F.when(count.isNotNull(), F.format_string("%,d", count.cast("bigint")))


def title(name: Column) -> Column:
    """``day_1_retention`` -> ``Day 1 Retention``."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))
