"""Order-preserving codes, radix selection and the AUROC that rests on them, against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from leakaudit.functions.codes import order_code, with_digits
from leakaudit.operators import metrics
from leakaudit.operators.quantiles import exact_quantiles


def test_codes_order_as_doubles_do(spark):
    values = [-math.inf, -1e308, -2.5, -1.0, -5e-324, 0.0, 5e-324, 1e-300, 1.0, 1.0 + 2**-52, 2.5, 1e308, math.inf, math.nan]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", order_code("v").alias("c")).collect()
    unsigned = [r.c % (1 << 64) for r in got]
    assert unsigned == sorted(unsigned) and len(set(unsigned)) == len(values)
    zeros = spark.createDataFrame([(0.0,), (-0.0,)], "v double").select(order_code("v").alias("c")).distinct()
    assert zeros.count() == 1
    near = with_digits(spark.range(1000).select((1 + F.col("id") * 2.0**-52).alias("v")), "v")
    assert near.select("d1", "d2").distinct().count() == 1


def test_quantiles_of_a_million_distinct_values_in_one_group(spark):
    probs = [0.0, 0.001, 0.37, 0.5, 0.99999, 1.0]
    df = spark.range(1_000_000).select(F.lit("hot").alias("g"), (1 + (F.xxhash64("id") % 1000003) * 1e-9 + F.col("id") * 1e-12).alias("v"))
    df = df.unionByName(spark.range(7).select(F.lit(None).cast("string").alias("g"), F.col("id").cast("double").alias("v")))
    got = {(r.g, r.prob_no): r.quantile for r in exact_quantiles(df, ["g"], "v", probs, 15).collect()}
    values = df.filter("g = 'hot'").toPandas().v.to_numpy()
    for i, p in enumerate(probs):
        assert got["hot", i] == pytest.approx(np.quantile(values, p), abs=1e-14)
        assert got[None, i] == pytest.approx(6 * p)


def test_quantiles_of_ties_signs_and_nothing(spark):
    values = [-3.0, -3.0, -1e-12, 0.0, -0.0, 0.0, 1e-12, 7.0, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    probs = [0.0, 0.2, 0.5, 0.9, 1.0]
    got = {r.prob_no: r.quantile for r in exact_quantiles(df, [], "v", probs, 15).collect()}
    assert [got[i] for i in range(5)] == pytest.approx([float(np.quantile([v for v in values if v is not None], p)) for p in probs], abs=1e-15)
    assert exact_quantiles(df.filter("v > 100"), [], "v", probs).count() == 0


def test_a_null_score_counts_as_the_lowest(spark):
    df = spark.createDataFrame([(1, None), (0, 0.2), (1, 0.9), (0, -0.5)], "y int, score double")
    assert metrics.auroc(df).first().auroc == pytest.approx(2 / 4)
    assert metrics.auroc(df, buckets=False).first().auroc == pytest.approx(2 / 4)


def test_auroc_of_crowded_scores(spark):
    """All scores share their leading digits; some are equal."""
    df = spark.range(20000).select((F.col("id") % 3).alias("g"), (F.xxhash64("id") % 2 == 0).cast("int").alias("y"), (0.5 + (F.xxhash64("id", F.lit(1)) % 5000) * 2.0**-52).alias("score"))
    got = {r.g: r.auroc for r in metrics.auroc(df, ["g"]).collect()}
    rows = df.toPandas()
    for g, part in rows.groupby("g"):
        ranks = part.score.rank()
        pos = part.y == 1
        n, m = pos.sum(), (~pos).sum()
        assert got[g] == pytest.approx((ranks[pos].sum() - n * (n + 1) / 2) / (n * m), abs=1e-12)
