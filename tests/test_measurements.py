from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from leakaudit.operators import measurements as m
from leakaudit.operators.measurements import Item

T0 = datetime(2024, 1, 1, 12, 0)
EVENTS = "stay_id long, itemid long, charttime timestamp_ntz, valuenum double, warning int"
ITEMS = [Item(1, "sbp", above=0.0, needs_clear_warning=True), Item(2, "fio2", low=21.0, high=100.0, divisor=100.0)]


@pytest.fixture(scope="module")
def cohort(spark):
    return spark.createDataFrame([(1, 71, T0), (2, 72, T0)], "stay_id long, hadm_id long, intime timestamp_ntz")


def hourly(spark, cohort, rows, items=ITEMS, horizon=72):
    df = spark.createDataFrame([(s, i, T0 + timedelta(minutes=t), v, w) for s, i, t, v, w in rows], EVENTS)
    out = m.hourly_means(df, cohort, items, horizon).collect()
    return {(r.stay_id, r.feature, r.hours_from_admit): r.value for r in out}


def test_hour_before_the_origin_and_hour_after_the_horizon_stay(spark, cohort):
    rows = [(1, 1, t, 10.0, 0) for t in (-61, -60, -59, -30, 0, 72 * 60 + 59, 73 * 60)]
    assert set(hourly(spark, cohort, rows)) == {(1, "sbp", -1.0), (1, "sbp", 0.0), (1, "sbp", 72.0)}


def test_validity_rules(spark, cohort):
    rows = [(1, 1, 0, 0.0, 0), (1, 1, 0, 5.0, 1), (1, 1, 0, 5.0, None), (1, 1, 0, None, 0), (1, 3, 0, 5.0, 0),
            (9, 1, 0, 5.0, 0), (1, 2, 0, 20.9, 0), (1, 2, 0, 21.0, 1), (1, 2, 5, 100.0, 0), (1, 2, 5, 100.1, 0)]
    assert hourly(spark, cohort, rows) == {(1, "fio2", 0.0): pytest.approx(0.605)}


def test_hourly_mean(spark, cohort):
    rows = [(1, 1, 1, 10.0, 0), (1, 1, 59, 20.0, 0), (1, 1, 60, 40.0, 0), (2, 1, 5, 7.0, 0)]
    assert hourly(spark, cohort, rows) == {(1, "sbp", 0.0): 15.0, (1, "sbp", 1.0): 40.0, (2, "sbp", 0.0): 7.0}


def test_laboratory_rows_join_by_admission(spark, cohort):
    df = spark.createDataFrame([(72, 1, T0, 3.0)], "hadm_id long, itemid long, charttime timestamp_ntz, valuenum double")
    rows = m.hourly_means(df, cohort, [Item(1, "ph")], 72, key="hadm_id").collect()
    assert [tuple(r) for r in rows] == [(2, "ph", 0.0, 3.0)]


def test_hot_stay_is_exact(spark, cohort):
    hot = spark.range(20_000).select(
        F.lit(1).cast("long").alias("stay_id"), F.lit(1).cast("long").alias("itemid"),
        F.lit(T0).cast("timestamp_ntz").alias("charttime"), (F.col("id") % 100 + 1.0).alias("valuenum"), F.lit(0).alias("warning"),
    )
    assert m.hourly_means(hot, cohort, ITEMS, 72).first().value == pytest.approx(50.5)


LONG = "stay_id long, feature string, hours_from_admit double, value double"


def test_relabel_keeps_both_rows_and_preference_keeps_one(spark):
    rows = [(1, "mbp", 0.0, 60.0), (1, "mbp_arterial", 0.0, 80.0), (1, "mbp_arterial", 1.0, 90.0), (1, "sbp", 0.0, 1.0)]
    df = spark.createDataFrame(rows, LONG)
    both = m.relabel(df, ["mbp", "mbp_arterial"], "mbp").filter("feature = 'mbp'")
    assert sorted(r.value for r in both.collect()) == [60.0, 80.0, 90.0]
    first = m.relabel_preferring(df, ["mbp", "mbp_arterial"], "mbp")
    assert sorted((r.feature, r.value) for r in first.collect()) == [("mbp", 60.0), ("mbp", 90.0), ("sbp", 1.0)]


def test_nearest_reading_prefers_the_earlier(spark):
    rows = [(1, "pao2", 5.0, 100.0), (1, "fio2", 3.0, 0.5), (1, "fio2", 7.0, 0.25), (2, "pao2", 5.0, 90.0),
            (2, "fio2", 6.0, 0.3), (3, "pao2", 1.0, 80.0), (4, "pao2", 2.0, 60.0), (4, "fio2", 2.0, 0.6)]
    got = {r.stay_id: r.ratio for r in m.nearest_ratio(spark.createDataFrame(rows, LONG), "pao2", "fio2").collect()}
    assert got == {1: 200.0, 2: pytest.approx(300.0), 4: 100.0}
    near = m.nearest_ratio(spark.createDataFrame(rows, LONG), "pao2", "fio2", max_gap=1.0).collect()
    assert {r.stay_id for r in near} == {2, 4}
