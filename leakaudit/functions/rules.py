"""Threshold rules as CASE expressions, and the organ-failure score built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Published 1996 organ-failure score thresholds.
RESPIRATORY_BELOW = [(100.0, 4), (200.0, 3), (300.0, 2), (400.0, 1)]
PLATELETS_BELOW = [(20.0, 4), (50.0, 3), (100.0, 2), (150.0, 1)]
GCS_BELOW = [(6.0, 4), (10.0, 3), (13.0, 2), (15.0, 1)]
BILIRUBIN_FROM = [(12.0, 4), (6.0, 3), (2.0, 2), (1.2, 1)]
CREATININE_FROM = [(5.0, 4), (3.5, 3), (2.0, 2), (1.2, 1)]
MAP_FLOOR = 70.0
GCS_DEFAULTS = {"eye": 4.0, "verbal": 5.0, "motor": 6.0}


# Rules take column names (or SQL expressions) and are written as one CASE each.


def _case(value: str, op: str, thresholds: Sequence[tuple[float, int]]) -> Column:
    steps = " ".join(f"WHEN {value} {op} {limit}D THEN {points}" for limit, points in thresholds)
    return F.expr(f"CASE WHEN {value} IS NULL THEN NULL {steps} ELSE 0 END")


def points_below(value: str, thresholds: Sequence[tuple[float, int]]) -> Column:
    """Points of the first threshold the value lies under; 0 past all; NULL stays NULL."""
    return _case(value, "<", thresholds)


def points_from(value: str, thresholds: Sequence[tuple[float, int]]) -> Column:
    """Points of the first threshold the value reaches; 0 short of all; NULL stays NULL."""
    return _case(value, ">=", thresholds)


def respiratory_points(pf_ratio: str) -> Column:
    return points_below(pf_ratio, RESPIRATORY_BELOW)


def coagulation_points(platelets: str) -> Column:
    return points_below(platelets, PLATELETS_BELOW)


def liver_points(bilirubin: str) -> Column:
    return points_from(bilirubin, BILIRUBIN_FROM)


def renal_points(creatinine: str) -> Column:
    return points_from(creatinine, CREATININE_FROM)


def cns_points(gcs: str) -> Column:
    return points_below(gcs, GCS_BELOW)


def coma_total(eye: str, verbal: str, motor: str) -> Column:
    """NULL when neither eye nor motor was seen; otherwise missing parts count as normal."""
    parts = zip((eye, verbal, motor), GCS_DEFAULTS.values(), strict=True)
    total = " + ".join(f"coalesce({part}, {normal}D)" for part, normal in parts)
    return F.expr(f"CASE WHEN {eye} IS NOT NULL OR {motor} IS NOT NULL THEN {total} END")


def pressure_points(mean_pressure: str) -> Column:
    return F.expr(f"CASE WHEN {mean_pressure} < {MAP_FLOOR}D THEN 1 ELSE 0 END")


def dose_points(dopamine: str, dobutamine: str, epi: str, norepi: str) -> Column:
    """Dose tier alone. Comparisons with a missing dose are not true, so it is no dose."""
    return F.expr(
        f"CASE WHEN {dopamine} > 15 OR {epi} > 0.1D OR {norepi} > 0.1D THEN 4"
        f" WHEN {dopamine} > 5 OR {epi} > 0 OR {norepi} > 0 THEN 3"
        f" WHEN {dopamine} > 0 OR {dobutamine} > 0 THEN 2 ELSE 0 END"
    )


def sum_present(*columns: str) -> Column:
    """Row sum skipping NULLs; NULL only when every input is."""
    total = " + ".join(f"coalesce({c}, 0)" for c in columns)
    return F.expr(f"CASE WHEN coalesce({', '.join(columns)}) IS NOT NULL THEN {total} END")


def any_positive(*columns: str) -> Column:
    """Whether any input is above 0; false, never NULL."""
    return F.expr(" OR ".join(f"coalesce({c}, 0) > 0" for c in columns))


def ratio(numerator: str, denominator: str) -> Column:
    return F.try_divide(F.col(numerator), F.col(denominator))


def overlap(start, end, lo: Column, hi: Column) -> Column:
    """Length of [start, end) inside [lo, hi), never negative."""
    return F.greatest(F.lit(0.0), F.least(F.col(end), hi) - F.greatest(F.col(start), lo))
