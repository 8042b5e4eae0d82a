"""Date arithmetic that the built-in functions do not spell directly."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def birth_date(year: Column, month: Column, day_of_month: Column) -> Column:
    """Date of birth; NULL when a part is missing or the date does not exist."""
    complete = year.isNotNull() & month.isNotNull() & day_of_month.isNotNull()
    text = F.concat_ws("-", year.cast("string"), month.cast("string"), day_of_month.cast("string"))
    return F.when(complete, F.try_to_date(text, "y-M-d"))


def age_in_years(index: Column, born: Column) -> Column:
    """Completed years, counting a year as 365.25 days."""
    return F.floor(F.date_diff(index, born) / F.lit(365.25)).cast("int")


def months_between_calendar(start: Column, end: Column) -> Column:
    """Whole calendar months from ``start`` to ``end`` plus left-over days / 30.4375.

    The whole months step back by one when the day of the month has not been reached
    yet, so 31 January to 28 February is zero months and 28 days.
    """
    raw = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    whole = raw - F.when(F.dayofmonth(end) < F.dayofmonth(start), 1).otherwise(0)
    left_over = F.date_diff(end, F.add_months(start, whole))
    return whole + left_over / F.lit(30.4375)
