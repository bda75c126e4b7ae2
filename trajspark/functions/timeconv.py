"""Times of GNSS and sensor logs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The GPS epoch in Unix seconds, seconds a week, leap seconds between GPS and UTC.
GPS_EPOCH = 315_964_800
WEEK_SECONDS = 604_800
LEAP_SECONDS = 18


def floor_second(ms: Column) -> Column:
    """[I5]"""
    return F.floor(ms / 1000).cast("long")


def rounded_second(ms: Column) -> Column:
    """Half goes to the even second."""
    return F.bround(ms.cast("decimal(20,3)") / 1000, 0).cast("long")


def micros_of(ts: Column) -> Column:
    """Microseconds of a timestamp; one without a zone is read in the session's, which should be UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def gps_to_unix(week: Column, second_of_week: Column, leap: int = LEAP_SECONDS) -> Column:
    """Unix seconds of a GPS week and second of week [I6]."""
    return F.lit(GPS_EPOCH) + week * WEEK_SECONDS + second_of_week - leap


def rinex_epoch(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    """Timestamp of a RINEX epoch, rounded to a microsecond; null if a part is none [I7]."""
    return F.try_make_timestamp(year, month, day, hour, minute, F.round(second, 6).cast("decimal(8,6)"))


def nmea_time(hhmmss: Column, ddmmyy: Column) -> Column:
    """UTC timestamp of an NMEA time and date; null if either is malformed [I4]."""
    part = lambda c, i: F.substring(c, i, 2).try_cast("int")
    year = F.lit(2000) + part(ddmmyy, 5)
    return F.try_make_timestamp(year, part(ddmmyy, 3), part(ddmmyy, 1), part(hhmmss, 1), part(hhmmss, 3), F.substring(hhmmss, 5, 9).try_cast("decimal(8,6)"))


def day_fraction(clock: Column) -> Column:
    """``hh:mm:ss.sss`` as a fraction of a day; missing parts are 0 [I8]."""
    parts = F.split(clock, ":")
    part = lambda i: F.coalesce(F.get(parts, i).try_cast("double"), F.lit(0.0))
    return (part(0) * 3600 + part(1) * 60 + part(2)) / 86400


def clock_label(ms: Column) -> Column:
    """``HH-mm-ss`` of Unix milliseconds in the session's time zone [I27]."""
    return F.date_format(F.timestamp_millis(ms.cast("long")), "HH-mm-ss")
