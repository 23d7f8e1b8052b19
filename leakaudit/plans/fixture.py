"""The test tables seen as stays, coded events and infusions (see FIXTURES.md).

Orders play stays for the cohort part; each user of ``events`` is one stay for the
time-series part. Values are functions of the row alone, so this is a projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakaudit.operators.cohort import CohortRule
from leakaudit.operators.grid import Grid
from leakaudit.operators.measurements import Item, literal_table
from leakaudit.sources.tables import read_table

GRID = Grid(interval=24.0, lookback=144.0, horizon=432.0)

# Item code -> (feature, low, high) of the derived reading. Codes are
# ten times the event type's number plus k modulo 6.
EVENT_TYPES = {"click": 1, "error": 2, "signup": 3, "view": 4}
READINGS = {
    10: ("heart_rate", 50.0, 150.0),
    11: ("sbp", 70.0, 180.0),
    12: ("dbp", 40.0, 100.0),
    13: ("mbp", 45.0, 105.0),
    14: ("mbp_arterial", 45.0, 105.0),
    15: ("resp_rate", 8.0, 40.0),
    20: ("spo2", 80.0, 100.0),
    21: ("temp_f", 94.0, 105.0),
    22: ("gcs_eye", 1.0, 5.0),
    23: ("gcs_verbal", 1.0, 6.0),
    24: ("gcs_motor", 1.0, 7.0),
    25: ("creatinine", 0.4, 6.4),
    30: ("bilirubin_total", 0.2, 15.2),
    31: ("platelets", 5.0, 255.0),
    32: ("wbc", 2.0, 30.0),
    33: ("lactate", 0.5, 10.5),
    34: ("potassium", 2.5, 6.5),
    35: ("sodium", 120.0, 160.0),
    40: ("bun", 5.0, 105.0),
    41: ("pao2", 45.0, 445.0),
    42: ("paco2", 20.0, 80.0),
    43: ("ph", 6.9, 7.7),
    44: ("fio2", 15.0, 105.0),
}
DRUGS = {50: "norepi", 51: "epi", 52: "dopamine", 53: "dobutamine", 54: "phenylephrine", 55: "vasopressin"}
RATE_DIVISORS = {50: 500.0, 51: 500.0, 52: 5.0, 53: 10.0, 54: 20.0, 55: 1000.0}
HADM_OFFSET = 500_000

VITALS = ["heart_rate", "sbp", "dbp", "mbp", "mbp_arterial", "resp_rate", "spo2", "temp_f",
          "gcs_eye", "gcs_verbal", "gcs_motor"]
LABS = ["creatinine", "bilirubin_total", "platelets", "wbc", "lactate", "potassium", "sodium",
        "bun", "pao2", "paco2", "ph"]
_CODES = {feature: code for code, (feature, _, _) in READINGS.items()}

VITAL_ITEMS = [Item(_CODES[f], f, above=0.0, needs_clear_warning=True) for f in VITALS]
LAB_ITEMS = [Item(_CODES[f], f) for f in LABS]
FIO2_ITEMS = [Item(_CODES["fio2"], "fio2", low=21.0, high=100.0, divisor=100.0)]

COHORT_RULE = CohortRule(
    excluded_units=("4-NOT SPECIFIED", "5-LOW"), min_age=0.0, min_los=50_000.0, exposure_items=(1, 2)
)


# --- cohort tables ----------------------------------------------------------------------


def order_stays(spark: SparkSession, sf: str) -> DataFrame:
    orders = read_table(spark, sf, "orders")
    return orders.select(
        F.col("o_custkey").alias("subject_id"),
        (F.col("o_orderkey") + HADM_OFFSET).alias("hadm_id"),
        F.col("o_orderkey").alias("stay_id"),
        F.col("o_orderdate").alias("intime"),
        F.col("o_orderdate").alias("outtime"),
        F.col("o_totalprice").alias("los"),
        F.col("o_orderpriority").alias("first_careunit"),
    )


def patients(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "customer").select(
        F.col("c_custkey").alias("subject_id"), F.col("c_acctbal").alias("anchor_age")
    )


def admissions(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "orders").select(
        (F.col("o_orderkey") + HADM_OFFSET).alias("hadm_id"),
        F.lit(None).cast("timestamp_ntz").alias("deathtime"),
        (F.col("o_orderstatus") == "F").cast("int").alias("hospital_expire_flag"),
    )


def line_exposures(spark: SparkSession, sf: str) -> DataFrame:
    """Items 1 and 2 are the exposing return flags, 3 the other one."""
    flag = F.col("l_returnflag")
    item = F.when(flag == "A", 1).when(flag == "R", 2).otherwise(3)
    return read_table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("stay_id"), item.alias("itemid"), F.col("l_quantity").alias("amount")
    )


def line_qualifier(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("stay_id"), (F.col("l_linestatus") == "F").alias("sepsis3")
    )


def cohort_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, ...]:
    return (
        order_stays(spark, sf),
        patients(spark, sf),
        admissions(spark, sf),
        line_exposures(spark, sf),
    )


# --- event tables -----------------------------------------------------------------------


_K = "CAST(get_json_object(props, '$.k') AS INT) AS k"


def user_stays(spark: SparkSession, sf: str) -> DataFrame:
    """One stay per user, starting at the user's first event."""
    return (
        read_table(spark, sf, "events")
        .groupBy(F.col("user_id").alias("stay_id"))
        .agg(F.min("ts").alias("intime"))
        .withColumn("hadm_id", F.col("stay_id") + HADM_OFFSET)
    )


def _item_code() -> str:
    cases = " ".join(f"WHEN '{name}' THEN {10 * number}" for name, number in EVENT_TYPES.items())
    return f"CAST(CASE event_type {cases} END + k % 6 AS BIGINT) AS itemid"


def chart_events(spark: SparkSession, sf: str) -> DataFrame:
    """Coded readings of every event but purchases; the unlisted code stays, valueless.

    Bounds come from a literal table, not a CASE over the code: a filter on the value
    would otherwise pull the JSON lookup behind the code into every branch.
    """
    rows = [(code, lo, hi - lo, feature.startswith("gcs_")) for code, (feature, lo, hi) in READINGS.items()]
    readings = F.broadcast(literal_table(spark, ["itemid", "lo", "span", "whole"], rows))
    events = read_table(spark, sf, "events").filter("event_type != 'purchase'")
    return (
        events.selectExpr("*", _K)
        .selectExpr("user_id AS stay_id", _item_code(), "ts AS charttime", "k", "event_id")
        .join(readings, "itemid", "left")
        .selectExpr("*", "lo + span * ((event_id * 7919 % 1000) / 1000.0D) AS v")
        .selectExpr(
            "stay_id",
            "itemid",
            "charttime",
            "CASE WHEN whole THEN CAST(floor(v) AS DOUBLE) ELSE v END AS valuenum",
            "CAST(k = 99 AS INT) AS warning",
        )
    )


def lab_events(spark: SparkSession, sf: str) -> DataFrame:
    """The same readings as laboratory rows: keyed by admission, without warnings."""
    return chart_events(spark, sf).select(
        (F.col("stay_id") + HADM_OFFSET).alias("hadm_id"), "itemid", "charttime", "valuenum"
    )


def infusions(spark: SparkSession, sf: str) -> DataFrame:
    """Each purchase starts an infusion lasting half its value in hours."""
    rates = " ".join(f"WHEN {code} THEN k / {divisor}D" for code, divisor in RATE_DIVISORS.items())
    return (
        read_table(spark, sf, "events")
        .filter("event_type = 'purchase'")
        .selectExpr("*", _K)
        .selectExpr("*", "CAST(50 + k % 6 AS BIGINT) AS itemid")
        .selectExpr(
            "user_id AS stay_id",
            "itemid",
            "ts AS starttime",
            "CASE WHEN k % 33 != 7 THEN timestampadd(SECOND, CAST(round(value * 1800) AS INT), ts) END AS endtime",
            f"CASE itemid {rates} END AS rate",
            "CASE WHEN k % 10 = 0 THEN 'mg/hr' WHEN k % 25 = 3 THEN NULL ELSE 'mcg/kg/min' END AS rateuom",
            "value AS amount",
        )
    )


def outcome(spark: SparkSession, sf: str) -> DataFrame:
    """(stay_id, reward): -1 for users whose customer account is overdrawn, else 1."""
    return read_table(spark, sf, "customer").select(
        F.col("c_custkey").alias("stay_id"),
        F.when(F.col("c_acctbal") < 0, F.lit(-1.0)).otherwise(F.lit(1.0)).alias("reward"),
    )
