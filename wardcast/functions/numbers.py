"""Tolerant parsing and the two rounding rules.

Projections round half to even on doubles; indicators round half up on decimals. Averages and
ratios that are shown rounded are formed from exact sums, so the result does not depend on how
the rows were split over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spark's own cast also takes "nan", "inf", hexadecimal floats and the suffixes d and f.
PLAIN_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def null_if_not_finite(value: Column) -> Column:
    """NULL for NaN and the infinities. Spark orders NaN above infinity, so one comparison covers all."""
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def _double_from_text(value: Column) -> Column:
    """The careful reading of text; infinity is left to the caller's cast or comparison to refuse."""
    return F.when(value.rlike(PLAIN_NUMBER), value.try_cast("double"))


def parse_double(value: Column, dtype: T.DataType) -> Column:
    """Number or NULL. Text must look like a plain number; numeric columns pass through.

    Whole numbers, the usual case, are read first, so the pattern is tried on the rest only.
    """
    if isinstance(dtype, T.StringType):
        return F.coalesce(value.try_cast("int").cast("double"), null_if_not_finite(_double_from_text(value)))
    number = value.try_cast("double")
    return null_if_not_finite(number) if isinstance(dtype, (T.FloatType, T.DoubleType)) else number


def parse_whole(value: Column, dtype: T.DataType) -> Column:
    """Integer or NULL; a fractional number is NULL. Text such as ``1e2`` counts as 100."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType)):
        return value.cast("int")
    text = isinstance(dtype, T.StringType)
    number = _double_from_text(value) if text else value.try_cast("double")
    whole = F.when(number == F.floor(number), number.try_cast("int"))
    return F.coalesce(value.try_cast("int"), whole) if text else whole


def parse_int(value: Column, dtype: T.DataType) -> Column:
    """Nearest integer (ties away from zero) or NULL."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType)):
        return value.cast("int")
    if isinstance(dtype, T.StringType):
        return F.coalesce(value.try_cast("int"), F.round(_double_from_text(value), 0).try_cast("int"))
    return F.round(value.try_cast("double"), 0).try_cast("int")


def parse_decimal(value: Column, dtype: T.DataType, precision: int = 15, scale: int = 2) -> Column:
    """Decimal or NULL. Text goes straight to decimal, which takes plain numbers only and is exact."""
    target = f"decimal({precision},{scale})"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return null_if_not_finite(value).try_cast(target)
    return value.try_cast(target)


def half_even(value: Column, digits: int = 0) -> Column:
    """Half to even on a double, scaled first as array libraries do. ``bround`` goes through the
    decimal text of the number instead and differs in the last digit near ties."""
    if digits == 0:
        return F.rint(value)
    scale = F.lit(float(10**digits))
    return F.rint(value * scale) / scale


def half_up(value: Column, digits: int = 0) -> Column:
    """Half away from zero; meant for decimals."""
    return F.round(value, digits)


def exact_mean(value: Column, digits: int) -> Column:
    """Aggregate: mean of a decimal(15,2) or integer column, rounded half up to ``digits``.

    These operand types make Spark keep 15 decimals in the quotient, enough for the second
    rounding to be right for groups of up to 10^13 rows.
    """
    total = F.sum(value).cast("decimal(25,2)")
    count = F.count(value).cast("decimal(15,0)")
    return half_up(F.try_divide(total, count), digits)


def exact_ratio(numerator: Column, denominator: Column, digits: int, scale: int = 1) -> Column:
    """``scale * numerator / denominator`` of whole numbers, rounded half up; NULL for a zero denominator."""
    top = numerator.cast("decimal(18,0)") * F.lit(scale).cast("decimal(3,0)")
    return half_up(F.try_divide(top, denominator.cast("decimal(18,0)")), digits)


def compound(value: Column, rate: Column, periods: Column) -> Column:
    """``value * (1 + rate) ** periods``."""
    return value * F.pow(F.lit(1.0) + rate, periods)


def in_millions(value: Column, digits: int = 2) -> Column:
    """Decimal amount in millions, rounded half up."""
    return half_up(value.cast("decimal(24,2)") / F.lit(1_000_000).cast("decimal(7,0)"), digits)
