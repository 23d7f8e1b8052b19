import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from leakaudit.plans import audit


@pytest.fixture
def table(spark):
    noise = lambda s: (F.xxhash64("id", F.lit(s)) % 1000) / 2000.0
    rows = spark.range(0, 600, 1, 2).select(
        F.col("id").alias("stay_id"), (F.col("id") % 7 * 5 + noise(1)).alias("a"), (F.col("id") % 5 * 3 + noise(2)).alias("b"), (F.col("id") % 2).cast("double").alias("y")
    )
    return rows.localCheckpoint()


def test_the_best_of_ten_starts(spark, table):
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="x").transform(table)
    costs = [KMeans(featuresCol="x", k=35, maxIter=300, seed=audit.SEED + i).fit(rows).summary.trainingCost for i in range(10)]
    best = audit.best_clustering(rows, 35).summary.trainingCost
    assert best == pytest.approx(min(costs)) and best < max(costs) * 0.99


def test_the_query_takes_all_starts_and_fails_at_the_cap(spark, table, monkeypatch):
    rewards = table.select("stay_id", F.col("y").alias("reward"))
    seeds = []
    monkeypatch.setattr(audit, "KMeans", lambda **p: seeds.append(p["seed"]) or KMeans(**p))
    (row,) = audit.policy_sensitivity(table, {"v": ["a", "b"]}, rewards, clusters=4, rounds=2).collect()
    assert len(set(seeds)) == 10 and row.greedy_action_rate == 1 and row.q_gap_mean > 0
    with pytest.raises(RuntimeError, match="no convergence"):
        audit.policy_sensitivity(table, {"v": ["a", "b"]}, rewards, clusters=8, rounds=2, cluster_rounds=1)
