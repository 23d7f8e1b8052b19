"""Shared k-means and boosting over cells against plain numpy and the separate MLlib fits."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from leakaudit.operators import clusters
from leakaudit.plans import audit


@pytest.fixture(scope="module")
def table(spark):
    noise = lambda s: (F.xxhash64("id", F.lit(s)) % 1000) / 2000.0
    return spark.range(0, 600, 1, 3).select(
        F.col("id").alias("stay_id"), (F.col("id") % 4).alias("bin"), (F.col("id") % 7 * 5 + noise(1)).alias("a"), (F.col("id") % 5 * 3 + noise(2)).alias("b"),
        noise(3).alias("c"), (F.col("id") % 2).cast("int").alias("y"),
    )


def plain(x, centres):
    return ((x[:, None, :] - centres[None, :, :]) ** 2).sum(2)


VARIANTS = {"two": ["a", "b"], "three": ["b", "c", "a"]}


def test_every_start_has_settled_and_costs_what_it_says(spark, table):
    rows = table.toPandas()
    found = clusters.every_start(table, VARIANTS, ["stay_id", "bin"], 12, starts=3)
    assert [(c.variant, c.start) for c in found] == [(v, s) for v in VARIANTS for s in range(3)]
    for c in found:
        x = rows[list(c.columns)].to_numpy()
        apart = plain(x, c.centres)
        assert c.cost == pytest.approx(apart.min(1).sum())
        nearest = apart.argmin(1)
        for k in range(12):
            assert np.allclose(x[nearest == k].mean(0), c.centres[k], atol=2e-4)
    assert len({round(c.cost, 6) for c in found}) > 2


def test_cost_is_not_above_the_separate_fits(spark, table):
    best = clusters.least_cost(clusters.every_start(table, {"two": ["a", "b"]}, ["stay_id", "bin"], 35))
    assembled = VectorAssembler(inputCols=["a", "b"], outputCol="x").transform(table)
    assert best[0].cost <= audit.best_clustering(assembled, 35).summary.trainingCost * (1 + 1e-9)


def test_partitions_do_not_change_the_result(spark, table):
    runs = [clusters.every_start(t, VARIANTS, ["stay_id", "bin"], 9, starts=2) for t in (table.coalesce(1), table.repartition(7, "c"))]
    for one, other in zip(*runs):
        assert one.steps == other.steps and np.allclose(one.centres, other.centres, atol=1e-9)


def test_copies_nulls_and_few_rows(spark):
    rows = spark.createDataFrame([(i, 0, None if i % 2 else 3.0) for i in range(40)], "stay_id long, bin int, v double")
    (c,) = clusters.every_start(rows, {"v": ["v"]}, ["stay_id", "bin"], 5, starts=1)
    assert c.cost == 0 and {0.0, 3.0} == set(c.centres[:, 0])
    placed = clusters.assigned(rows, [c], ["stay_id"]).groupBy("cluster").count().collect()
    assert sorted(r["count"] for r in placed) == [20, 20]
    with pytest.raises(ValueError, match="no rows"):
        clusters.every_start(rows.limit(0), {"v": ["v"]}, ["stay_id", "bin"], 5, starts=1)


def test_the_cap_fails(spark, table):
    with pytest.raises(RuntimeError, match="no convergence in 1 iterations"):
        clusters.every_start(table, {"three": ["a", "b", "c"]}, ["stay_id", "bin"], 8, starts=2, rounds=1)


def test_hot_entity_and_extra_columns(spark, table):
    hot = table.withColumn("stay_id", F.when(F.col("stay_id") % 3 == 0, 0).otherwise(F.col("stay_id"))).withColumn("model", F.lit("x")).withColumn("__h", F.lit(1))
    hot = hot.withColumn("bin", F.monotonically_increasing_id())
    (c,) = clusters.every_start(hot, {"two": ["a", "b"]}, ["stay_id", "bin"], 6, starts=1)
    assert clusters.assigned(hot, [c], ["stay_id", "model"]).count() == 600


def rowwise_boosting(x, y, asked, rounds):
    """The same trees grown on rows, every cut tried."""

    def tree(inside, there, left):
        r = residual[inside]
        best = (((r - r.mean()) ** 2).sum() - 1e-10, None, None)
        for j in range(x.shape[1]) if left else ():
            values = np.unique(x[inside, j])
            for cut in (values[1:] + values[:-1]) / 2:
                l = x[inside, j] <= cut  # noqa: E741
                error = ((r[l] - r[l].mean()) ** 2).sum() + ((r[~l] - r[~l].mean()) ** 2).sum()
                if error < best[0] - 1e-9:
                    best = (error, j, cut)
        if best[1] is None:
            fitted[inside] += 0.1 * r.mean()
            out[there] += 0.1 * r.mean()
            return
        _, j, cut = best
        tree(inside[x[inside, j] <= cut], there[asked[there, j] <= cut], left - 1)
        tree(inside[x[inside, j] > cut], there[asked[there, j] > cut], left - 1)

    fitted, out = np.full(len(x), y.mean()), np.full(len(asked), y.mean())
    for _ in range(rounds):
        residual = y - fitted
        tree(np.arange(len(x)), np.arange(len(asked)), 3)
    return out


def test_boosting_on_cells_equals_boosting_on_rows():
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.integers(0, 9, 300), rng.integers(0, 2, 300)]).astype(float)
    y = np.where((x[:, 0] * 7 % 5 + x[:, 1]) > 2, 1.0, -1.0) + rng.normal(0, 0.7, 300)
    cells, place = np.unique(x, axis=0, return_inverse=True)
    n = np.bincount(place)
    means = np.bincount(place, y) / n
    asked = np.array([(k, a) for k in range(9) for a in (0.0, 1.0)])
    got = clusters.boosted_values(cells, n.astype(float), means, asked, 25)
    assert np.allclose(got, rowwise_boosting(x, y, asked, 25), atol=1e-9)


def test_policy_agrees_with_its_parts(spark, table):
    rewards = table.select("stay_id", F.when(F.col("stay_id") % 2 == 1, 1.0).otherwise(-1.0).alias("reward")).filter("stay_id < 590")
    got = {r.variant: r for r in audit.policy_probe(table, VARIANTS, rewards, n_clusters=6, rounds=20, starts=2).collect()}
    assert set(got) == set(VARIANTS)
    for r in got.values():  # the reward is the action
        assert r.greedy_action_rate == 1 and r.q_gap_mean > 1
    certificate = audit.clustering_certificate(table, clusters.least_cost(clusters.every_start(table, VARIANTS, ["stay_id", "bin"], 6, starts=2)))
    assert {(r.n_rows, r.n_treated, r.settled) for r in certificate.collect()} == {(600, 300, 1)}
    moved = clusters.every_start(table, {"two": ["a", "b"]}, ["stay_id", "bin"], 6, starts=1)
    moved[0].centres[0] += 0.01
    assert audit.clustering_certificate(table, moved).first().settled == 0


def test_equal_rows_are_kept_once_for_the_steps(spark, table, monkeypatch):
    """Steps read distinct rows with their numbers, dealt over the cores, and copies weigh as many."""
    seen, plain_sums = [], clusters._sums
    monkeypatch.setattr(clusters, "_sums", lambda rows, *args, **kw: seen.append(rows) or plain_sums(rows, *args, **kw))
    few = table.withColumn("a", F.floor("a")).withColumn("b", F.floor("b"))
    (c,) = clusters.every_start(few, {"two": ["a", "b"]}, ["stay_id", "bin"], 6, starts=1)
    assert seen[0].count() <= 140 and seen[0].agg(F.sum("__n")).first()[0] == 600
    x = few.toPandas()[["a", "b"]].to_numpy()
    assert c.cost == pytest.approx(plain(x, c.centres).min(1).sum())


def test_least_distances_and_runs():
    rng = np.random.default_rng(4)
    centres = np.repeat(rng.normal(size=(9, 3)), 2, axis=0)
    x = np.concatenate([np.repeat(rng.normal(size=(50, 3)), 3, axis=0), centres])
    kinds, run = clusters._neighbours(x)
    assert len(kinds) == 59 and (kinds[run] == x).all()
    found = clusters._least_distances(kinds, clusters._ranked(centres))
    assert np.allclose(found, plain(kinds, centres).min(1)) and (found[50:] == 0).all()
