import pytest
from pyspark.sql import functions as F

from leakaudit.functions import rules


def score(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


@pytest.mark.parametrize(
    ("rule", "values", "expected"),
    [
        (rules.respiratory_points, [99.9, 100.0, 200.0, 300.0, 400.0, None], [4, 3, 2, 1, 0, None]),
        (rules.coagulation_points, [19.9, 20.0, 50.0, 100.0, 150.0, None], [4, 3, 2, 1, 0, None]),
        (rules.liver_points, [12.0, 6.0, 2.0, 1.2, 1.19, None], [4, 3, 2, 1, 0, None]),
        (rules.renal_points, [5.0, 3.5, 2.0, 1.2, 1.19, None], [4, 3, 2, 1, 0, None]),
        (rules.cns_points, [5.0, 6.0, 10.0, 13.0, 15.0, None], [4, 3, 2, 1, 0, None]),
        (rules.pressure_points, [69.9, 70.0, None], [1, 0, 0]),
    ],
)
def test_step_rules(spark, rule, values, expected):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, v double").orderBy("i").select(rule("v"))
    assert [r[0] for r in df.collect()] == expected


def test_coma_total(spark):
    rows = [(None, 5.0, None), (4.0, None, 6.0), (None, 1.0, 6.0), (1.0, None, None)]
    assert score(spark, rules.coma_total("e", "v", "m"), rows, "e double, v double, m double") == [None, 15.0, 11.0, 12.0]


def test_dose_tiers(spark):
    rows = [
        (0.0, 0.0, 0.0, 0.1), (0.0, 0.0, 0.0, 0.1001), (0.0, 0.0, 0.05, 0.0), (5.0, 0.0, 0.0, 0.0),
        (5.01, 0.0, 0.0, 0.0), (15.0, 0.0, 0.0, 0.0), (15.01, 0.0, 0.0, 0.0), (0.0, 0.5, 0.0, 0.0),
        (None, None, None, None), (-1.0, 0.0, 0.0, 0.0),
    ]
    got = score(spark, rules.dose_points("a", "b", "c", "d"), rows, "a double, b double, c double, d double")
    assert got == [3, 4, 3, 2, 3, 3, 4, 2, 0, 0]


def test_dose_hides_pressure(spark):
    rows = [(m, 6.0) for m in (40.0, 55.0, 70.0, 90.0)]
    total = F.greatest(rules.pressure_points("m"), rules.dose_points("dopa", "NULL", "NULL", "NULL"))
    assert score(spark, total, rows, "m double, dopa double") == [3, 3, 3, 3]


def test_sum_present(spark):
    rows = [(None, None), (1, None), (1, 2)]
    assert score(spark, rules.sum_present("a", "b"), rows, "a int, b int") == [None, 1, 3]


def test_any_positive_is_never_null(spark):
    rows = [(None, None), (0.0, None), (None, 0.1)]
    assert score(spark, rules.any_positive("a", "b"), rows, "a double, b double") == [False, False, True]
