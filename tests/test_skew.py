"""One entity holds most rows: plans split it, and results stay whole."""

from contextlib import contextmanager
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from leakaudit.operators import audits, cohort, intervals, measurements
from leakaudit.operators.grid import Grid
from leakaudit.operators.measurements import Item

T0 = datetime(2024, 1, 1)
GRID = Grid(4.0, 24.0, 72.0)


@contextmanager
def settings(spark, **values):
    old = {}
    for name, value in values.items():
        key = "spark.sql." + name.replace("__", ".")
        old[key] = spark.conf.get(key, None)
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in old.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def final_plan(df) -> str:
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


@pytest.fixture(scope="module")
def events(spark):
    hot = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 500)
    at = F.expr("timestampadd(MINUTE, CAST(id * 37 % 4300 AS INT), TIMESTAMP_NTZ '2024-01-01 00:00:00')")
    return spark.range(0, 400_000, 1, 16).select(
        hot.alias("stay_id"), (F.col("id") % 4).alias("itemid"), at.alias("charttime"),
        (F.col("id") % 97 + 1.0).alias("valuenum"), F.md5(F.col("id").cast("string")).alias("note"), F.lit(0).alias("warning"),
    )


def test_hot_stay_is_split_in_the_shuffle_join(spark, events):
    stays = spark.range(500).select(F.col("id").alias("stay_id"), F.col("id").alias("hadm_id"), F.lit(T0).cast("timestamp_ntz").alias("intime"))
    items = [Item(i, f"f{i}") for i in range(4)]
    plain = measurements.hourly_means(events, stays, items, 72)
    want = sorted(map(tuple, plain.collect()))
    small = {
        "autoBroadcastJoinThreshold": "-1",
        "adaptive__autoBroadcastJoinThreshold": "-1",
        "adaptive__advisoryPartitionSizeInBytes": "200KB",
        "adaptive__skewJoin__skewedPartitionThresholdInBytes": "300KB",
        "adaptive__skewJoin__skewedPartitionFactor": "2",
    }
    with settings(spark, **small):
        df = measurements.hourly_means(events, stays, items, 72)
        got = sorted(map(tuple, df.collect()))
        assert "skew=true" in final_plan(df)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want])


def test_copies_of_a_hot_interval_collapse_before_the_exchange(spark):
    rows = spark.range(0, 300_000, 1, 8).select(
        F.when(F.col("id") % 3 > 0, F.lit(1)).otherwise(F.col("id") % 50 + 2).alias("stay_id"),
        (F.col("id") % 40).cast("double").alias("start_h"), (F.col("id") % 40 + 0.5).alias("end_h"),
    )
    islands = intervals.interval_union(rows).filter("stay_id = 1")
    assert islands.count() == 40
    share = intervals.window_contamination(rows, GRID, 4.0).filter("stay_id = 1 AND bin < 10")
    assert {r.contaminated_hours for r in share.collect()} == {2.0}
    plan = intervals.interval_union(rows)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.rindex("Exchange hashpartitioning(stay_id") :]
    assert "partial_max(end_h" in below


def test_hot_subject_sends_one_row_per_task(spark):
    rows = spark.range(0, 100_000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("subject_id"),
        F.col("id").alias("stay_id"), (-F.col("id")).alias("intime"),
    )
    first = cohort.first_qualifying(rows)
    assert first.filter("subject_id = 7").first().stay_id == 99_999
    assert first.count() == rows.select("subject_id").distinct().count()


def test_fanout_counts_a_hot_key_whole(spark):
    rows = spark.range(90_000).select(F.when(F.col("id") < 30_000, F.lit(0)).otherwise(F.col("id")).alias("k"))
    got = audits.key_fanout(rows, ["k"]).first()
    assert (got.n_rows, got.n_keys, got.max_copies, got.n_repeated_keys) == (90_000, 60_001, 30_000, 1)
