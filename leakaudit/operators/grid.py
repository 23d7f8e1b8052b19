"""The regular decision grid, and moving irregular observations onto it.

Nothing here joins on a range. Which bins a point or an interval touches is plain
arithmetic on the grid, so every placement is an ``explode`` inside one stage and
the only shuffles are those of the aggregates that follow.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """Decision bins of ``interval`` hours up to ``horizon``; bin t decides at (t+1)*interval."""

    interval: float = 4.0
    lookback: float = 24.0
    horizon: float = 72.0

    @property
    def n_bins(self) -> int:
        return int(self.horizon // self.interval)


def decision_grid(entities: DataFrame, grid: Grid, key: str = "stay_id") -> DataFrame:
    """Every entity with every bin and its short and long window bounds."""
    decided = (F.col("bin") + 1) * F.lit(float(grid.interval))
    return (
        entities.select(key, F.explode(F.sequence(F.lit(0), F.lit(grid.n_bins - 1))).alias("bin"))
        .withColumn("decision_time", decided)
        .withColumn("short_start", decided - F.lit(float(grid.interval)))
        .withColumn("long_start", decided - F.lit(float(grid.lookback)))
    )


def explode_bins(df: DataFrame, first: Column, last: Column, grid: Grid, every: Column | None = None) -> DataFrame:
    """One row per bin in [first, last] clipped to the grid; rows touching none go away.
    Rows for which ``every`` is true take all bins."""
    lo = F.greatest(first.cast("int"), F.lit(0))
    hi = F.least(last.cast("int"), F.lit(grid.n_bins - 1))
    bins = F.when(lo <= hi, F.sequence(lo, hi))
    if every is not None:
        bins = F.when(every, F.sequence(F.lit(0), F.lit(grid.n_bins - 1))).otherwise(bins)
    return df.withColumn("bin", F.explode(bins))


def point_bins(df: DataFrame, hour: str, width: float, grid: Grid) -> DataFrame:
    """Bins whose trailing window [decision - width, decision) holds the point."""
    h, step = F.col(hour), F.lit(float(grid.interval))
    return explode_bins(df, F.floor(h / step), F.floor((h + width) / step) - 1, grid)


def touching_bins(df: DataFrame, start: str, end: str, grid: Grid) -> DataFrame:
    """Bins strictly overlapped by the interval: start < bin end and end > bin start."""
    step = F.lit(float(grid.interval))
    return explode_bins(df, F.floor(F.col(start) / step), F.ceil(F.col(end) / step) - 1, grid)


def covered_windows(df: DataFrame, start: str, end: str, width, grid: Grid, every: Column | None = None) -> DataFrame:
    """Bins whose trailing window of ``width`` hours shares time with the interval."""
    step = F.lit(float(grid.interval))
    w = width if isinstance(width, Column) else F.lit(float(width))
    return explode_bins(df, F.floor(F.col(start) / step), F.ceil((F.col(end) + w) / step) - 2, grid, every)


# --- trailing-window aggregates ---------------------------------------------------
#
# Input is hourly, so an entity holds a bounded number of rows and partitioning by
# entity is even. That one exchange serves everything after it: repeating a point for
# the windows it belongs to, the aggregates per bin, scores and labels all stay local.


def _placed(long: DataFrame, grid: Grid, width: float, key: str, hour: str) -> DataFrame:
    return point_bins(long.repartition(key), hour, width, grid)


def _named(stats: Mapping[str, str], stat: str) -> str:
    return ", ".join(f"'{f}'" for f, s in sorted(stats.items()) if s == stat) or "NULL"


def windowed_features(
    long: DataFrame,
    grid: Grid,
    width: float,
    stats: Mapping[str, str],
    key: str = "stay_id",
    hour: str = "hours_from_admit",
) -> DataFrame:
    """(key, feature, bin, value): mean, min or max of each feature's hourly points in the
    trailing window; windows holding no point give no row."""
    value = (
        f"CASE WHEN feature IN ({_named(stats, 'max')}) THEN max(value)"
        f" WHEN feature IN ({_named(stats, 'min')}) THEN min(value) ELSE avg(value) END AS value"
    )
    return _placed(long, grid, width, key, hour).groupBy(key, "feature", "bin").agg(F.expr(value))


def wide_features(
    windowed: DataFrame, features: Sequence[str], key: str = "stay_id"
) -> DataFrame:
    """One column per feature. Conditional aggregates instead of ``pivot``: one shuffle
    and a schema fixed by the feature list, whatever the data holds."""
    columns = [F.expr(f"avg(value) FILTER (WHERE feature = '{f}') AS {f}") for f in features]
    return windowed.groupBy(key, "bin").agg(*columns)


def windowed_wide(
    long: DataFrame,
    grid: Grid,
    width: float,
    stats: Mapping[str, str],
    features: Sequence[str],
    key: str = "stay_id",
    hour: str = "hours_from_admit",
) -> DataFrame:
    """``wide_features(windowed_features(...))`` as a single aggregate."""
    how = {"mean": "avg", "min": "min", "max": "max"}
    columns = [
        F.expr(f"{how[stats.get(f, 'mean')]}(value) FILTER (WHERE feature = '{f}') AS {f}") for f in features
    ]
    return _placed(long, grid, width, key, hour).groupBy(key, "bin").agg(*columns)
