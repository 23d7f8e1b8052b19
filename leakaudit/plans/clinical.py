"""A clinical preset: intensive-care source tables as the inputs of an audit.

The tables are given as DataFrames with the source's own column names; codes, rules and
units are the values of the audited study.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from leakaudit.operators import intervals
from leakaudit.operators.cohort import CohortRule, build_cohort
from leakaudit.operators.grid import Grid
from leakaudit.operators.measurements import Item
from leakaudit.plans.audit import Sources

# Item codes, validity rules, exposures, doses, time grid.
VITALS = {
    220045: "heart_rate",
    220179: "sbp",
    220180: "dbp",
    220181: "mbp",
    220052: "mbp_arterial",
    220210: "resp_rate",
    220277: "spo2",
    223761: "temp_f",
    220739: "gcs_eye",
    223900: "gcs_verbal",
    223901: "gcs_motor",
}
LABS = {
    50912: "creatinine",
    50885: "bilirubin_total",
    51265: "platelets",
    51301: "wbc",
    50813: "lactate",
    50971: "potassium",
    50983: "sodium",
    51006: "bun",
    50821: "pao2",
    50818: "paco2",
    50820: "ph",
}
FIO2_ITEM, FIO2_LOW, FIO2_HIGH, FIO2_DIVISOR = 223835, 21.0, 100.0, 100.0
DRUGS = {
    221906: "norepi",
    221289: "epi",
    221662: "dopamine",
    221653: "dobutamine",
    221749: "phenylephrine",
    222315: "vasopressin",
}
EXPOSURES = (221906, 221289, 222315, 221749, 221662)
MOST_STAYS = 20000
HOURS = {"interval": 4.0, "lookback": 24.0, "horizon": 72}

VITAL_ITEMS = [Item(code, name, above=0.0, needs_clear_warning=True) for code, name in VITALS.items()]
LAB_ITEMS = [Item(code, name) for code, name in LABS.items()]
FIO2_ITEMS = [Item(FIO2_ITEM, "fio2", low=FIO2_LOW, high=FIO2_HIGH, divisor=FIO2_DIVISOR)]
RULE = CohortRule(exposure_items=EXPOSURES, limit=MOST_STAYS)
GRID = Grid(**HOURS)


def clinical_sources(
    stays: DataFrame,
    patients: DataFrame,
    admissions: DataFrame,
    inputs: DataFrame,
    chart: DataFrame,
    labs: DataFrame,
    qualifier: DataFrame | None = None,
    grid: Grid = GRID,
) -> Sources:
    """Cohort and cleaned infusions from the source tables, with all codes in place."""
    cohort = build_cohort(stays, patients, admissions, inputs, RULE, qualifier)
    infusions = intervals.infusion_intervals(inputs, cohort, DRUGS)
    return Sources(cohort, chart, labs, intervals.unit_guard(infusions), grid, VITAL_ITEMS, LAB_ITEMS, FIO2_ITEMS)
