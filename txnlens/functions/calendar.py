"""Date and time functions of a payment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from txnlens.constants import HOUR_INTENSITY, MONTH_DAY_INTENSITY, WEEKDAY_INTENSITY

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR


def micros(ts: Column | str = "timestamp") -> Column:
    """Microseconds since 1970, the ordering key of every time frame."""
    return F.unix_micros(ts)


def calendar_columns(ts: Column | str = "timestamp") -> dict[str, Column]:
    """Hour, weekday (Monday = 0), day, month and weekend flag."""
    return {
        "hour_of_day": F.hour(ts),
        "day_of_week": F.weekday(ts),
        "day_of_month": F.dayofmonth(ts),
        "month_of_year": F.month(ts),
        "is_weekend": F.weekday(ts).isin(5, 6).cast("int"),
    }


def seconds_since_midnight(ts: Column | str = "timestamp") -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def step_to_timestamp(step: Column | str, start: str = "2025-01-01", minutes: int = 10) -> Column:
    """Turn a step counter into a time: ``minutes`` per step from ``start``."""
    step = F.col(step) if isinstance(step, str) else step
    return F.timestamp_add("MINUTE", (step * minutes).cast("int"), F.lit(start).cast("timestamp"))


def plus_seconds(ts: Column | str, seconds: Column) -> Column:
    """A time moved by fractional seconds, at microsecond grain."""
    return F.timestamp_micros(F.unix_micros(ts) + F.round(seconds * SECOND).cast("bigint"))


def iso_text(ts: Column | str = "timestamp") -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def _lookup(key: Column, table: dict[int, float], other: float) -> Column:
    pairs = [F.lit(part) for item in table.items() for part in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(other))


def intensity(ts: Column | str = "timestamp") -> Column:
    """How busy a moment is: hour x weekday x day of month."""
    return (
        _lookup(F.hour(ts), HOUR_INTENSITY, 0.01)
        * _lookup(F.weekday(ts), WEEKDAY_INTENSITY, 1.0)
        * _lookup(F.dayofmonth(ts), MONTH_DAY_INTENSITY, 1.0)
    )
