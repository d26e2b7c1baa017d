"""Calendar and clock expressions on TIMESTAMP_NTZ columns.

All of them read the stored fields directly, so the session time zone has no
influence.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, functions as F

_EPOCH = "1970-01-01"
_MICROS_PER_DAY = 86_400_000_000


def ntz(value: datetime | None) -> Column:
    """Literal of a wall-clock time.

    It goes by text, as a datetime literal would pass through the zones of the
    driver and of the session.
    """
    return F.lit(None if value is None else value.isoformat(sep=" ")).cast("timestamp_ntz")


def day_of(ts: Column) -> Column:
    """Calendar day, time of day cut off."""
    return F.to_date(ts)


def day_name(ts: Column) -> Column:
    """Three letters in upper case, e.g. ``MON``."""
    return F.upper(F.dayname(F.to_date(ts)))


def clock_hour(ts: Column) -> Column:
    """Hour on the twelve-hour dial: midnight and noon both read 12."""
    return ((F.hour(ts) + 11) % 12 + 1).cast("int")


def clock_second(ts: Column) -> Column:
    return F.second(ts)


def micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 as bigint, exact."""
    ts = ts.cast("timestamp_ntz")
    days = F.datediff(F.to_date(ts), F.lit(_EPOCH).cast("date")).cast("bigint")
    seconds = (F.hour(ts) * 60 + F.minute(ts)) * 60
    within_minute = (F.date_part(F.lit("second"), ts) * 1_000_000).cast("bigint")
    return days * F.lit(_MICROS_PER_DAY) + seconds.cast("bigint") * F.lit(1_000_000) + within_minute


def days_between(start: Column, end: Column) -> Column:
    """Fractional days from ``start`` to ``end``."""
    return (micros(end) - micros(start)) / F.lit(float(_MICROS_PER_DAY))


def rounded_days(start: Column, end: Column) -> Column:
    """Whole days, halves rounded away from zero."""
    return F.round(days_between(start, end))


def calendar_columns(prefix: str, ts: Column) -> dict[str, Column]:
    return {
        f"{prefix}YEAR": F.year(ts),
        f"{prefix}MONTH": F.month(ts),
        f"{prefix}DAY": F.dayofmonth(ts),
        f"{prefix}DOW": day_name(ts),
    }
