"""Calendar functions over naive UTC timestamps. Every clock reading is a parameter, never the wall clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def eastern(ts: Column) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), ts)


def week_label(day: Column) -> Column:
    """The Sunday that ends the week of a day; a Sunday is its own."""
    return F.next_day(F.date_sub(day, 1), "SUN")


def half_hour(ts: Column) -> Column:
    """Minutes since midnight, down to the half hour."""
    return F.hour(ts) * 60 + F.floor(F.minute(ts) / 30).cast("int") * 30


def weekday(ts: Column) -> Column:
    return F.date_format(ts, "EEEE")


def half_hours(first: Column, last: Column) -> Column:
    """Half hours from the hour of ``first`` up to, not including, the hour of ``last``; none if these are equal."""
    a, b = F.date_trunc("hour", first), F.date_trunc("hour", last)
    step = F.expr("interval 30 minutes")
    return F.when(a < b, F.sequence(a, b - step, step))


#: Patterns of the pages, besides that of :func:`shown`.
PATTERNS = {"day": "EEEE, MMMM d", "iso": "yyyy-MM-dd'T'HH:mm:ss", "stamp": "yyyyMMddHHmmss", "clock": "h:mm a", "year": "yyyy"}


def shown(ts: Column) -> Column:
    """A time as tables show it: short month, day and twelve-hour clock. As text it does not sort by time."""
    return F.date_format(ts, "MMM d h:mm a")


def period(minutes: Column) -> Column:
    """Quarter of the day, right-closed: midnight itself belongs to none."""
    return F.when((minutes > 0) & (minutes <= 360), "night").when((minutes > 360) & (minutes <= 720), "morning").when((minutes > 720) & (minutes <= 1080), "afternoon").when((minutes > 1080) & (minutes <= 1440), "evening")


def whole_days(first: Column, last: Column) -> Column:
    """Whole days between two times, plus one."""
    return F.floor((F.unix_micros(last.cast("timestamp")) - F.unix_micros(first.cast("timestamp"))) / F.lit(86_400_000_000)) + 1
