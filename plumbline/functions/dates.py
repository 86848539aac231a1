"""Expressions over dates; each takes the instant it counts as now."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def since_day_start(ts: Column, as_of: Column) -> Column:
    """DT-02: whether an instant is in the day of `as_of` or later."""
    return ts >= F.date_trunc("day", as_of).cast("timestamp_ntz")


def is_stale(ts: Column, as_of: Column, days: int) -> Column:
    """DT-03: older than a number of days, or unset."""
    return ts.isNull() | (ts < as_of - F.make_dt_interval(F.lit(days)))


def expires(as_of: Column, days: Column) -> Column:
    """DT-05."""
    return as_of + F.make_dt_interval(days.cast("int"))


def lease_until(as_of: Column, minutes: int = 30) -> Column:
    """DT-06: the end of a new lease."""
    return as_of + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))


def is_expired(until: Column, as_of: Column) -> Column:
    """DT-08: at its end already, too."""
    return until <= as_of


def parse_iso(text: Column) -> Column:
    """DT-07: an instant in UTC from an ISO date or time, with Z, an offset or neither; null for anything else."""
    t = F.trim(text)
    date = F.when(t.rlike(r"^\d{4}-\d\d-\d\d$"), F.concat(t, F.lit("T00:00:00Z")))
    plain = F.when(t.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d+)?)?$"), F.concat(F.replace(t, F.lit(" "), F.lit("T")), F.lit("Z")))
    zoned = F.when(t.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:\d\d)$"), F.replace(t, F.lit(" "), F.lit("T")))
    return F.to_utc_timestamp(F.try_to_timestamp(F.coalesce(date, plain, zoned)), F.current_timezone()).cast("timestamp_ntz")


def is_year(number: Column) -> Column:
    """DT-10."""
    return number.rlike(r"^(19|20)\d\d$")
