"""Time column expressions. Everything is zone-free (TIMESTAMP_NTZ)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000
HOUR_MICROS = 3_600_000_000


def moment(value: datetime | str | Column) -> Column:
    """A point in time given as a Column, a datetime or ISO text."""
    if isinstance(value, Column):
        return value.cast("timestamp_ntz")
    text = value if isinstance(value, str) else value.isoformat(sep=" ")
    return F.lit(text).cast("timestamp_ntz")


def micros_between(start: Column, end: Column) -> Column:
    """Signed microseconds from start to end."""
    gap = end.cast("timestamp_ntz") - start.cast("timestamp_ntz")
    return (
        F.extract(F.lit("DAY"), gap).cast("bigint") * DAY_MICROS
        + F.extract(F.lit("HOUR"), gap).cast("bigint") * HOUR_MICROS
        + F.extract(F.lit("MINUTE"), gap).cast("bigint") * 60_000_000
        + (F.extract(F.lit("SECOND"), gap) * 1_000_000).cast("bigint")
    )


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01."""
    return micros_between(F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def floor_div(value: Column, step: int) -> Column:
    """Integer floor division, also right for negative values."""
    return F.call_function("div", value - F.pmod(value, F.lit(step)), F.lit(step))


def days_since(date: Column, as_of: datetime | str | Column) -> Column:
    """Whole days elapsed (floor, so a future date is negative); unreadable input gives 0."""
    when = date.try_cast("timestamp_ntz")
    return F.coalesce(floor_div(micros_between(when, moment(as_of)), DAY_MICROS), F.lit(0).cast("bigint")).cast("int")


def hours(n: int) -> Column:
    return F.expr(f"INTERVAL {int(n)} HOURS")


def days(n: int) -> Column:
    return F.expr(f"INTERVAL {int(n)} DAYS")


def to_instant(ts: Column) -> Column:
    """A plain UTC wall-clock time as a zoned instant, whatever the session zone (streams need one)."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), ts).cast("timestamp")


def from_instant(ts: Column) -> Column:
    """Back from an instant to the plain UTC wall-clock time."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), ts.cast("timestamp_ntz"))


def utc_text(text: Column) -> Column:
    """ISO text with or without an offset as plain UTC time; unreadable text gives null."""
    zoned = text.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})\s*$")
    return F.when(zoned, from_instant(text.try_cast("timestamp"))).otherwise(text.try_cast("timestamp_ntz"))
