"""Number expressions with fixed decimals, so results do not depend on partition order."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_count() -> Column:
    return F.count(F.lit(1))


def exact(value: Column, scale: int = 2) -> Column:
    """A decimal copy; cast before summing so that sums are exact."""
    return value.cast(f"decimal(18,{scale})")


def ratio(num: Column, den: Column, scale: int = 2, times: int = 1,
          zero: int | None = None) -> Column:
    """`num * times / den` rounded half up; NULL (or `zero`) on a zero denominator.

    Rounded from the remainder, so the result is that of exact arithmetic (inputs keep
    four decimals).
    """
    n = F.abs((num * F.lit(times)).cast("decimal(30,4)") * F.lit(10 ** scale))
    d = F.abs(den.cast("decimal(30,4)"))
    rest = F.try_mod(n, d)
    whole = F.try_divide(n - rest, d).cast("decimal(37,0)") + F.when(rest * 2 >= d, 1).otherwise(0)
    q = whole.cast("decimal(37,0)") * F.lit(Decimal(1).scaleb(-scale)) * F.when((num < 0) != (den < 0), -1).otherwise(1)
    q = F.when(den != 0, q).cast(f"decimal(28,{scale})")
    return q if zero is None else F.when(den == 0, F.lit(zero)).otherwise(q).cast(f"decimal(28,{scale})")


def whole_ratio(num: Column, den: Column, scale: int = 2, times: int = 1) -> Column:
    """`ratio` for two whole numbers, in 64-bit arithmetic where that suffices; for use on
    every row of a large table."""
    n, d = num.cast("bigint"), den.cast("bigint")
    size = F.try_multiply(F.abs(n), F.lit(2 * times * 10 ** scale).cast("bigint"))
    twice = F.nullif(F.try_multiply(F.abs(d), F.lit(2).cast("bigint")), F.lit(0).cast("bigint"))
    quick = F.call_function("div", F.try_add(size, F.abs(d)), twice)
    signed = F.when((n < 0) != (d < 0), -quick).otherwise(quick)
    as_decimal = (signed.cast("decimal(18,0)") * F.lit(Decimal(1).scaleb(-scale))).cast(f"decimal(28,{scale})")
    return F.when(d == 0, None).when(signed.isNotNull(), as_decimal).otherwise(ratio(num, den, scale, times))


def percent(part: Column, whole: Column, scale: int = 2, zero: int | None = None) -> Column:
    return ratio(part, whole, scale, 100, zero)


def int_div(num: Column, den: Column, zero: int | None = None) -> Column:
    """Truncating division of whole numbers; NULL (or `zero`) on a zero denominator."""
    d = F.nullif(den.cast("bigint"), F.lit(0).cast("bigint"))
    q = F.call_function("div", num.cast("bigint"), d)
    return q if zero is None else F.when(den == 0, F.lit(zero)).otherwise(q).cast("bigint")


def pages_to_mb(pages: Column) -> Column:
    """8 KB pages to whole MB, truncated."""
    return F.floor(pages.cast("bigint") * 8 / 1024).cast("bigint")
