"""Hour arithmetic on zone-free times (session zone UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def floor_hour(t: Column | str) -> Column:
    return F.date_trunc("hour", _col(t))


def ceil_hour(t: Column | str) -> Column:
    """The next full hour; a time already on the hour stays."""
    t = _col(t)
    cut = floor_hour(t)
    return F.when(t == cut, t).otherwise(cut + F.expr("INTERVAL 1 HOUR"))


def plus_hours(t: Column | str, hours: Column | float | int) -> Column:
    """Shift by a number of hours, which may be a column."""
    micros = (F.lit(hours) if not isinstance(hours, Column) else hours) * F.lit(HOUR_US)
    return F.timestamp_micros((F.unix_micros(_col(t)) + micros).cast("long"))


def hours_between(later: Column | str, earlier: Column | str) -> Column:
    """Difference in hours as a double; null if either is null."""
    return (F.unix_micros(_col(later)) - F.unix_micros(_col(earlier))) / F.lit(float(HOUR_US))


def hour_number(t: Column | str) -> Column:
    """Full hours since 1970, an integer usable as a range-frame order key."""
    return F.floor(F.unix_micros(_col(t)) / F.lit(HOUR_US)).cast("long")


def naive(t: Column | str) -> Column:
    """Drop the zone: the UTC wall clock of an instant."""
    return _col(t).cast("timestamp_ntz")


def instant(t: Column | str) -> Column:
    """A zone-free time as an instant in the session zone, so that epoch functions accept it."""
    return _col(t).cast("timestamp")
