"""Time since an origin. Whole units truncate toward zero, in every function."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole_hours(origin, ts) -> Column:
    return F.timestamp_diff("HOUR", origin, ts)


def elapsed_hours(origin, ts) -> Column:
    """Fractional hours at minute resolution."""
    return F.timestamp_diff("MINUTE", origin, ts) / F.lit(60.0)


def hour_bucket(origin, ts) -> Column:
    """Floored hour; an event up to 59 minutes before the origin lands in bucket -1."""
    return F.floor(elapsed_hours(origin, ts)).cast("double")


def within_horizon(origin, ts, horizon: float) -> Column:
    """Truncated hours in [0, horizon]: keeps the hour before the origin and the
    whole hour after the horizon."""
    return whole_hours(origin, ts).between(0, horizon)
