"""Money, ratios and their display forms.

Money is kept as whole cents in bigint columns and divided once, at the end, so
sums are exact and do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wrenchlight.functions.text import col


def to_cents(c: Column | str) -> Column:
    """Any numeric or text column as whole cents; unusable values become NULL."""
    return F.bround(col(c).try_cast("double")).try_cast("bigint")


def number_or(c: Column | str, default: float | int, type_name: str = "double") -> Column:
    return F.coalesce(col(c).try_cast(type_name), F.lit(default).cast(type_name))


def dollars(cents: Column | str) -> Column:
    """Cents as dollars, 0 for NULL."""
    return number_or(cents, 0) / F.lit(100.0)


def currency(amount: Column | str) -> Column:
    """'$1,234', halves to even; NULL, NaN and infinities show as '$0'."""
    value = col(amount).try_cast("double")
    usable = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.concat(F.lit("$"), F.format_number(F.when(usable, value).otherwise(F.lit(0.0)), 0))


def ratio(numerator: Column | str, denominator: Column | str, digits: int | None = None) -> Column:
    """numerator / denominator, 0.0 where the denominator is not positive."""
    value = col(numerator) / col(denominator)
    if digits is not None:
        value = F.bround(value, digits)
    return F.when(col(denominator) > 0, value).otherwise(F.lit(0.0))


def percent(numerator: Column | str, denominator: Column | str, digits: int | None = None) -> Column:
    """Share in percent, 0.0 where the denominator is not positive."""
    value = col(numerator) / col(denominator) * F.lit(100.0)
    if digits is not None:
        value = F.bround(value, digits)
    return F.when(col(denominator) > 0, value).otherwise(F.lit(0.0))


def fixed_point(value: Column | str, digits: int, suffix: str = "") -> Column:
    """Text with a fixed number of decimals and an optional suffix."""
    return F.format_string(f"%.{digits}f{suffix.replace('%', '%%')}", F.bround(col(value), digits))


def clamp_percent(value: Column | str) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), col(value)))
