import numpy as np
import pytest

from leakaudit.operators import metrics, probes
from leakaudit.operators.probes import ProbeSettings
from leakaudit.plans import audit

QUICK = ProbeSettings(trees=5, boosting_rounds=3, max_iter=50, folds=3)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    rows = []
    for s in range(60):
        for b in range(8):
            y = int(rng.random() < 0.3)
            rows.append((s, b, y, float(y + rng.normal()), float(rng.normal())))
    return spark.createDataFrame(rows, "stay_id long, bin int, y int, signal double, noise double").cache()


def test_probes_find_signal_and_not_noise(table):
    variants = {"with": ["signal", "noise"], "without": ["noise"]}
    out = probes.out_of_fold(table, variants, ("logreg", "rf", "gb"), QUICK).cache()
    assert out.count() == 6 * table.count()
    assert out.select("variant", "probe", "stay_id", "bin").distinct().count() == out.count()
    auc = {(r.variant, r.probe): r.auroc for r in metrics.auroc(out, ["variant", "probe"]).collect()}
    for p in ("logreg", "rf", "gb"):
        assert auc["with", p] > 0.65 and abs(auc["without", p] - 0.5) < 0.12


def test_balanced_penalised_fit_matches_newton_steps(table):
    """The penalty is on the summed loss: compare with an independent solver."""
    pdf = table.toPandas()
    x, y = pdf[["signal", "noise"]].to_numpy(), pdf["y"].to_numpy()
    n, n1 = len(y), y.sum()
    w = np.where(y == 1, n / (2 * n1), n / (2 * (n - n1)))
    a = np.column_stack([x, np.ones(n)])
    beta = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ beta))
        penalty = np.array([1.0, 1.0, 0.0])
        grad = a.T @ (w * (p - y)) + penalty * beta
        hess = (a * (w * p * (1 - p))[:, None]).T @ a + np.diag(penalty)
        beta -= np.linalg.solve(hess, grad)
    from pyspark.ml.feature import VectorAssembler
    from pyspark.sql import functions as F

    rows = VectorAssembler(inputCols=["signal", "noise"], outputCol="x").transform(table)
    rows = rows.withColumn("w", F.when(F.col("y") == 1, float(n / (2 * n1))).otherwise(float(n / (2 * (n - n1)))))
    model = probes.PROBES["logreg"].make(ProbeSettings(), float(n)).fit(rows)
    assert [*model.coefficients, model.intercept] == pytest.approx(list(beta), abs=1e-3)


def test_class_weights(spark, table):
    from leakaudit.operators.resample import group_folds

    rows = {(r.fold, r.y): r for r in probes.class_weights(group_folds(table, 3), k=3).collect()}
    pdf = group_folds(table, 3).toPandas()
    for (fold, y), r in rows.items():
        train = pdf[pdf.fold != fold]
        assert r.n == len(train) and r.weight == pytest.approx(len(train) / (2 * (train.y == y).sum()))
    assert len(rows) == 6


def test_best_probe_and_gap(spark):
    rows = [("A_full", "gb", 0.9), ("A_full", "rf", 0.9), ("E_physiology_only", "rf", 0.7), ("E_physiology_only", "logreg", 0.75)]
    best = audit.best_probe(spark.createDataFrame(rows, "variant string, probe string, auroc double"))
    assert {r.variant: r.probe for r in best.collect()} == {"A_full": "rf", "E_physiology_only": "logreg"}
    assert audit.recoverability_gap(best).first().gap == pytest.approx(0.15)


def test_decay_verdict(spark):
    rows = [(0, 0.9), (1, 0.88), (8, 0.85)]
    df = spark.createDataFrame(rows, "offset_bins int, auroc double")
    row = audit.decay_verdict(df).first()
    assert row.decay == pytest.approx(0.05) and row.reading == "persistence"


def test_a_fit_that_did_not_converge_fails(table):
    with pytest.raises(RuntimeError, match="no convergence"):
        probes.out_of_fold(table, {"v": ["signal", "noise"]}, ("logreg",), ProbeSettings(max_iter=1, folds=3))
