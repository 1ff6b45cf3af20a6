"""Rounding and money labels with one rule everywhere: halves go up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole_div(a: Column, b: Column) -> Column:
    """Integer division of longs that truncates; null for a zero divisor."""
    return F.call_function("div", a.cast("long"), F.nullif(b.cast("long"), F.lit(0)))


def percent(a: Column, b: Column) -> Column:
    """floor(100 a / b + 0.5) for a >= 0 and b > 0, exact in integers; null where b is 0."""
    return whole_div(a.cast("long") * 200 + b.cast("long"), b.cast("long") * 2)


def percent_difference(a: Column, b: Column) -> Column:
    """Percent by which a is over b, halves up: 0 if both are 0, 100 if only b is."""
    return F.when((a == 0) & (b == 0), F.lit(0).cast("long")).when(b == 0, F.lit(100).cast("long")).otherwise(percent(a, b) - 100)


def reverse_score(amount: Column, base: int) -> Column:
    """100 for nothing, 0 from ``base`` on; the part taken off is truncated."""
    return F.greatest(F.lit(0).cast("long"), F.lit(100).cast("long") - whole_div(amount.cast("long") * 100, F.lit(base)))


def half_up(x: Column) -> Column:
    """floor(x + 0.5) as a long."""
    return F.floor(x + 0.5).cast("long")


def won_label(amount: Column) -> Column:
    """Thousands groups and the unit; free for 0."""
    return F.when(amount == 0, "무료").otherwise(F.concat(F.format_number(amount.cast("long"), 0), F.lit("원")))


def manwon_label(amount: Column, digits: int = 0) -> Column:
    """In units of 10,000 with ``digits`` decimals (0 or 1), halves up."""
    scaled = whole_div(amount.cast("long") * 10**digits * 2 + 10_000, F.lit(20_000))
    if not digits:
        return F.concat(scaled.cast("string"), F.lit("만원"))
    return F.concat(whole_div(scaled, F.lit(10)).cast("string"), F.lit("."), (scaled % 10).cast("string"), F.lit("만원"))


def performance_label(amount: Column) -> Column:
    """In units of 10,000 with as many decimals as it takes (four at most shown as three); none for 0."""
    return F.when(amount == 0, "무실적").otherwise(F.concat(F.call_function("format_number", amount.cast("decimal(20,4)") / 10_000, F.lit("#,##0.###")), F.lit("만원")))
