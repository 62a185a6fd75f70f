"""Time expressions. Slots and hours are TIMESTAMP_NTZ in UTC."""

from datetime import datetime, timedelta

from pyspark.sql import Column, functions as F

NTZ = "timestamp_ntz"


def at(moment: datetime) -> Column:
    """A zone-less literal for an ``as_of`` moment."""
    return F.lit(moment.isoformat(sep=" ")).cast(NTZ)


def parse_utc(text: Column) -> Column:
    """ISO text to a slot timestamp in UTC; bad text is NULL.

    Whatever zone the engine's own cast reads is applied: ``Z``, an offset with or without
    a blank before it, or a zone's name. Text without one is in the session's zone, which
    the jobs set to UTC.
    """
    local = text.try_cast("timestamp").cast(NTZ)
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), local)


def parse_utc_offset(text: Column) -> Column:
    """Minute-precise ISO text with ``Z`` or a zone offset, shifted to UTC."""
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mmXXX")).cast(NTZ)


def hour_of(ts: Column) -> Column:
    return F.date_trunc("hour", ts).cast(NTZ)


def slot_of(ts: Column) -> Column:
    """Start of the half hour."""
    past_half = F.when(F.minute(ts) >= 30, F.expr("INTERVAL 30 MINUTES"))
    return hour_of(ts) + F.coalesce(past_half, F.expr("INTERVAL 0 MINUTES"))


def local_time(ts: Column, zone: str) -> Column:
    """Wall-clock time in ``zone`` of a UTC timestamp."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)


def weekday_number(ts: Column) -> Column:
    """0 is Sunday."""
    return F.dayofweek(ts) - 1


def weekday_name(ts: Column) -> Column:
    return F.dayname(ts)


def day_type(ts: Column) -> Column:
    return F.when(F.dayofweek(ts).isin(1, 7), "weekend").otherwise("weekday")


def as_text(ts: Column) -> Column:
    return ts.cast("string")


def plus(ts: Column, step: timedelta) -> Column:
    return ts + F.lit(step)
