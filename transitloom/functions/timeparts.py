"""Fields of a fixed UTC+8 clock from epoch milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OFFSET_MS, DAY_MS, HOUR_MS, SLOT_MS = 28_800_000, 86_400_000, 3_600_000, 1_800_000
#: Named periods, half-open in fractional hours; the last wraps past midnight.
PERIODS = {
    "pre_rush": (5.0, 7.0),
    "morning_peak": (7.0, 10.0),
    "midday": (10.0, 12.0),
    "lunch_surge": (12.0, 14.0),
    "afternoon_calm": (14.0, 16.5),
    "evening_peak": (16.5, 20.0),
    "post_peak": (20.0, 22.0),
    "late_night": (22.0, 26.0),
}
#: The service day, from 05:00 to 01:30.
SERVICE_START_MIN, SERVICE_MIN = 300, 1230


def _local(t: Column) -> Column:
    return t + F.lit(OFFSET_MS)


def _div(x: Column, by: int) -> Column:
    return ((x - F.pmod(x, F.lit(by))) / F.lit(by)).cast("long")


def day_number(t: Column) -> Column:
    return _div(_local(t), DAY_MS)


def local_date(t: Column) -> Column:
    return F.date_from_unix_date(day_number(t).cast("int"))


def midnight_ms(t: Column) -> Column:
    return day_number(t) * DAY_MS - OFFSET_MS


def ms_of_day(t: Column) -> Column:
    return F.pmod(_local(t), F.lit(DAY_MS))


def local_hour(t: Column) -> Column:
    return _div(ms_of_day(t), HOUR_MS).cast("int")


def frac_hour(t: Column) -> Column:
    """The hour plus its whole minutes over 60."""
    minutes = _div(ms_of_day(t), 60_000)
    return _div(minutes, 60) + F.pmod(minutes, F.lit(60)) / F.lit(60.0)


def half_hour_bucket(t: Column) -> Column:
    return _div(ms_of_day(t), SLOT_MS).cast("int")


def fractional_bucket(t: Column) -> Column:
    """A slot in [0, 48) from whole seconds."""
    return _div(ms_of_day(t), 1000) / F.lit(1800.0)


def in_period(key: str, hour: Column) -> Column:
    start, end = PERIODS[key]
    if end > 24:
        return (hour >= start) | (hour < end - 24)
    return (hour >= start) & (hour < end)


def period_of(hour: Column) -> Column:
    """The period's key; null from 02:00 to 05:00."""
    found = F.lit(None).cast("string")
    for key in reversed(PERIODS):
        found = F.when(in_period(key, hour), key).otherwise(found)
    return found


def in_hour_range(hour: Column, first: float, last: float) -> Column:
    return hour.between(first, last)


def service_minutes(t: Column) -> Column:
    """Minutes into the service day, hours before 05:00 belonging to the day before, capped at its length."""
    since = F.pmod(_div(ms_of_day(t), 60_000) - SERVICE_START_MIN, F.lit(1440))
    return F.least(since, F.lit(SERVICE_MIN)).cast("int")
