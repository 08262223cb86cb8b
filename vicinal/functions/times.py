"""Business days in the reporting time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Europe/Istanbul"


def business_day(instant: Column, zone: str = ZONE) -> Column:
    return F.to_date(F.from_utc_timestamp(instant, zone))


def day_bounds(day: Column, zone: str = ZONE) -> tuple[Column, Column]:
    """UTC instants at which a business day begins and ends; days may have 23 or 25 hours."""
    at = lambda d: F.to_utc_timestamp(d.cast("timestamp"), zone)
    return at(day), at(F.date_add(day, 1))


def attribution_days(hours: int) -> int:
    """Whole days that a window of hours reaches back."""
    return -(-hours // 24)


def trailing_days(last: Column, hours: int) -> Column:
    """The days to be rolled up anew: the last one and those that the window reaches, in order."""
    return F.sequence(F.date_sub(last, attribution_days(hours)), last)
