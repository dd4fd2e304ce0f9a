"""Calendars without holidays as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def add_business_days(day: Column, n: Column) -> Column:
    """The date n business days (Monday to Friday) after a date, or before it if n is below 0.

    From a weekend, days are counted after the Friday before it, or back from the Monday after it; 0 days from a weekend is that Friday.
    """
    weekday = F.weekday(day)
    base = F.when(weekday < 5, day).when(n >= 0, F.date_sub(day, weekday - 4)).otherwise(F.date_add(day, 7 - weekday))
    place = F.weekday(base)
    total = place + n
    rest = F.pmod(total, F.lit(5))
    return F.date_add(base, (-place + (total - rest) / 5 * 7 + rest).cast("int"))
