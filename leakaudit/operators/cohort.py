"""Who is studied: filters, first qualifying stay, exposure, qualifier, attrition."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CohortRule:
    excluded_units: Sequence[str] = ("NICU", "PICU")
    min_age: float = 18.0
    min_los: float = 1.0
    exposure_items: Sequence[int] = field(default_factory=tuple)
    limit: int | None = None

    def steps(self) -> list[tuple[str, Column]]:
        """The row filters in order. An unknown care unit fails the exclusion test."""
        return [
            ("care_unit", ~F.col("first_careunit").isin(list(self.excluded_units))),
            ("age", F.col("anchor_age") >= self.min_age),
            ("length_of_stay", F.col("los") >= self.min_los),
        ]


STAY_COLUMNS = [
    "subject_id", "hadm_id", "stay_id", "intime", "outtime", "los", "first_careunit",
    "anchor_age", "deathtime", "hospital_expire_flag",
]


def join_stays(stays: DataFrame, patients: DataFrame, admissions: DataFrame) -> DataFrame:
    return (
        stays.join(patients.select("subject_id", "anchor_age"), "subject_id")
        .join(admissions.select("hadm_id", "deathtime", "hospital_expire_flag"), "hadm_id")
        .select(*STAY_COLUMNS)
    )


def first_qualifying(rows: DataFrame, subject: str = "subject_id", order: Sequence[str] = ("intime", "stay_id")) -> DataFrame:
    """Each subject's first row among those passed in - filter first, rank after.

    ``row_number() = 1`` is planned with a group limit on both sides of the exchange,
    so a subject with many rows sends one row per task, not its whole history.
    """
    place = F.row_number().over(Window.partitionBy(subject).orderBy(*order))
    return rows.withColumn("rn", place).filter(F.col("rn") == 1)


def exposed_keys(exposures: DataFrame, items: Sequence[int], key: str = "stay_id") -> DataFrame:
    """Distinct entities with any listed exposure of positive amount. Deduplicating on
    the map side keeps a heavily exposed entity from crowding one join task."""
    hit = F.col("itemid").isin(list(items)) & (F.col("amount") > 0)
    return exposures.filter(hit).select(key).distinct()


def qualified_keys(qualifier: DataFrame, flag: str = "sepsis3", key: str = "stay_id") -> DataFrame:
    return qualifier.filter(F.col(flag).eqNullSafe(F.lit(True))).select(key).distinct()


def build_cohort(
    stays: DataFrame,
    patients: DataFrame,
    admissions: DataFrame,
    exposures: DataFrame,
    rule: CohortRule,
    qualifier: DataFrame | None = None,
) -> DataFrame:
    """One row per entity. Without a qualifier table that filter is left out, and the
    ``qualifier_applied`` column says so on every row."""
    rows = join_stays(stays, patients, admissions)
    for _, test in rule.steps():
        rows = rows.filter(test)
    cohort = first_qualifying(rows).join(exposed_keys(exposures, rule.exposure_items), "stay_id", "left_semi")
    if qualifier is not None:
        cohort = cohort.join(qualified_keys(qualifier), "stay_id", "left_semi")
    cohort = cohort.withColumn("qualifier_applied", F.lit(qualifier is not None))
    if rule.limit is not None:
        # Fails rather than silently truncating when the safety cap would bind.
        within = cohort.select(F.count(F.lit(1)).alias("n")).scalar() <= rule.limit
        cohort = cohort.filter(F.when(within, True).otherwise(F.raise_error(F.lit("the cohort exceeds its cap"))))
    return cohort


def cohort_flow(
    stays: DataFrame,
    patients: DataFrame,
    admissions: DataFrame,
    exposures: DataFrame,
    rule: CohortRule,
    qualifier: DataFrame,
) -> DataFrame:
    """(step_no, step, n): rows left after each cohort step, from one aggregate.

    The joins all use the stay key, so the stays are exchanged once for the lot.
    """
    rows = join_stays(stays, patients, admissions)
    passed = [(name, test) for name, test in rule.steps()]
    filtered = rows
    for _, test in passed:
        filtered = filtered.filter(test)
    first = first_qualifying(filtered).select("stay_id", F.lit(True).alias("is_first"))
    exposed = exposed_keys(exposures, rule.exposure_items).withColumn("is_exposed", F.lit(True))
    qualified = qualified_keys(qualifier).withColumn("is_qualified", F.lit(True))
    flagged = rows.join(first, "stay_id", "left").join(exposed, "stay_id", "left").join(qualified, "stay_id", "left")

    running, columns = F.lit(True), [("source", F.lit(True))]
    for name, test in passed:
        running = running & F.coalesce(test, F.lit(False))
        columns.append((name, running))
    for name, flag in [("first_stay", "is_first"), ("exposed", "is_exposed"), ("qualified", "is_qualified")]:
        running = running & F.coalesce(F.col(flag), F.lit(False))
        columns.append((name, running))
    counts = flagged.agg(*[F.count_if(test).alias(name) for name, test in columns])
    steps = F.array(
        *[
            F.struct(F.lit(i).alias("step_no"), F.lit(name).alias("step"), F.col(name).alias("n"))
            for i, (name, _) in enumerate(columns)
        ]
    )
    return counts.select(F.inline(steps))
