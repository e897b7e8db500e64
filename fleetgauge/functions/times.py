"""Time expressions. All counts are of calendar boundaries crossed, not elapsed units."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO = "%Y-%m-%d %H:%M:%S.%f"


def instant(as_of: str | datetime) -> Column:
    """The pinned "now" as a zone-less literal."""
    text = as_of if isinstance(as_of, str) else as_of.strftime(ISO)
    return F.lit(text).cast("timestamp_ntz")


def before(as_of: str | datetime, **delta: float) -> Column:
    """`as_of` minus an interval, folded on the driver so that filters push down."""
    moment = datetime.fromisoformat(as_of) if isinstance(as_of, str) else as_of
    return instant(moment - timedelta(**delta))


def read_instant(text: Column) -> Column:
    """A UTC time stamp in ISO form, with or without fraction and Z; NULL for anything else."""
    full = text.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(\.\d{1,9})?Z?$")
    return F.when(full, F.regexp_replace(text, "Z$", "").try_cast("timestamp_ntz"))


def boundary_count(unit: str, ts: Column) -> Column:
    """Number of `unit` boundaries since 1970-01-01 in the fields of `ts`."""
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("bigint")
    if unit == "day":
        return days
    hours = days * 24 + F.hour(ts)
    if unit == "hour":
        return hours
    minutes = hours * 60 + F.minute(ts)
    if unit == "minute":
        return minutes
    if unit == "second":
        return minutes * 60 + F.second(ts)
    raise ValueError(f"unknown unit {unit!r}")


def boundary_diff(unit: str, start: Column, end: Column) -> Column:
    """Boundaries crossed from `start` to `end`; 00:00:59 to 00:01:01 is one minute."""
    return boundary_count(unit, end) - boundary_count(unit, start)


def unpack_datetime(yyyymmdd: Column, hhmmss: Column) -> Column:
    """Packed integers to a timestamp; 0 or an impossible date gives NULL."""
    d = yyyymmdd.cast("int")
    t = hhmmss.cast("int")
    return F.try_make_timestamp_ntz(
        (d / 10000).cast("int"), ((d / 100).cast("int") % 100), d % 100,
        (t / 10000).cast("int"), ((t / 100).cast("int") % 100), (t % 100).cast("decimal(8,6)"),
    )


def unpack_duration(hhmmss: Column) -> Column:
    """Packed hhmmss to seconds; hours may exceed 24."""
    d = hhmmss.cast("bigint")
    return F.floor(d / 10000) * 3600 + F.floor((d % 10000) / 100) * 60 + d % 100
