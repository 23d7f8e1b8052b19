from datetime import datetime

import pytest

from leakaudit.operators import cohort as c

STAYS = ("subject_id long, hadm_id long, stay_id long, intime timestamp_ntz, outtime timestamp_ntz, los double,"
         " first_careunit string")  # fmt: skip
DAY = [datetime(2024, 1, d) for d in range(1, 10)]


@pytest.fixture(scope="module")
def inputs(spark):
    stays = [
        (1, 11, 101, DAY[0], DAY[1], 0.5, "MICU"),   # too short: the next one is first
        (1, 12, 102, DAY[1], DAY[3], 2.0, "MICU"),
        (1, 13, 103, DAY[2], DAY[4], 2.0, "MICU"),
        (2, 21, 201, DAY[0], DAY[3], 3.0, "NICU"),   # excluded unit
        (3, 31, 301, DAY[0], DAY[3], 3.0, None),     # unknown unit
        (4, 41, 401, DAY[0], DAY[3], 3.0, "SICU"),   # a child
        (5, 51, 502, DAY[0], DAY[3], 3.0, "SICU"),   # tie on time: smaller stay first
        (5, 52, 501, DAY[0], DAY[3], 3.0, "SICU"),
        (6, 61, 601, DAY[0], DAY[3], 3.0, "SICU"),   # never exposed
    ]
    patients = [(1, 40), (2, 40), (3, 40), (4, 17), (5, 18), (6, 70)]
    admissions = [(h, None, 0) for h in (11, 12, 13, 21, 31, 41, 51, 52, 61)]
    exposures = [(102, 7, 1.0), (102, 7, 1.0), (501, 8, 2.0), (601, 7, 0.0), (601, 9, 5.0), (401, 7, 1.0)]
    return (
        spark.createDataFrame(stays, STAYS),
        spark.createDataFrame(patients, "subject_id long, anchor_age int"),
        spark.createDataFrame(admissions, "hadm_id long, deathtime timestamp_ntz, hospital_expire_flag int"),
        spark.createDataFrame(exposures, "stay_id long, itemid long, amount double"),
    )


RULE = c.CohortRule(exposure_items=(7, 8))


def ids(df):
    return sorted(r.stay_id for r in df.collect())


def test_first_qualifying_exposed_stays(spark, inputs):
    qualifier = spark.createDataFrame([(102, True), (102, True), (501, None), (501, False)], "stay_id long, sepsis3 boolean")
    built = c.build_cohort(*inputs, RULE, qualifier)
    assert ids(built) == [102] and built.first().qualifier_applied
    fallback = c.build_cohort(*inputs, RULE)
    assert ids(fallback) == [102, 501] and not fallback.first().qualifier_applied


def test_cap_that_binds_fails(inputs):
    assert ids(c.build_cohort(*inputs, c.CohortRule(exposure_items=(7, 8), limit=2))) == [102, 501]
    with pytest.raises(Exception, match="exceeds its cap"):
        c.build_cohort(*inputs, c.CohortRule(exposure_items=(7, 8), limit=1)).collect()


def test_flow_counts(spark, inputs):
    qualifier = spark.createDataFrame([(102, True)], "stay_id long, sepsis3 boolean")
    rows = c.cohort_flow(*inputs, RULE, qualifier).orderBy("step_no").collect()
    assert [(r.step, r.n) for r in rows] == [
        ("source", 9), ("care_unit", 7), ("age", 6), ("length_of_stay", 5), ("first_stay", 3), ("exposed", 2), ("qualified", 1),
    ]


def test_first_stay_limits_rows_before_the_exchange(inputs):
    plan = c.build_cohort(*inputs, RULE)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
