"""Number formatting for report tables."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def count_text(value: Column) -> Column:
    """Whole number with thousands separators; halves go to the even neighbour."""
    return F.format_number(F.bround(value.cast("double"), 0), 0)


def decimal_text(value: Column, digits: int = 1) -> Column:
    """Number with thousands separators and a fixed number of decimals."""
    return F.format_number(F.round(value.cast("double"), digits), digits)


def count_percent_text(count: Column, total: Column) -> Column:
    """``"n (p%)"``."""
    share = F.try_divide(count.cast("double"), total.cast("double")) * 100
    return F.concat(count_text(count), F.lit(" ("), decimal_text(share), F.lit("%)"))


def median_range_text(low: Column, mid: Column, high: Column, digits: int) -> Column:
    """``"median [q1 to q3]"``."""
    show = count_text if digits == 0 else (lambda c: decimal_text(c, digits))
    return F.concat(show(mid), F.lit(" ["), show(low), F.lit(" to "), show(high), F.lit("]"))


def sentence_case(text: Column) -> Column:
    """First letter upper, the rest lower."""
    return F.concat(F.upper(F.left(text, F.lit(1))), F.lower(F.substr(text, F.lit(2))))
