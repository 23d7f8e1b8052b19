from leakaudit.operators.probes import ProbeSettings
from leakaudit.plans import catalog
from leakaudit.plans.run import Options, run_audit

SF = "/root/testdata/sf0.001"


def test_whole_audit_writes_every_table(spark, tmp_path):
    options = Options(
        settings=ProbeSettings(max_iter=200, folds=3), probes=("logreg",), offsets=(0, 4), n_boot=10, fit_scope="fold"
    )
    built = run_audit(spark, catalog._sources(spark, SF), str(tmp_path), options, "run_test")
    assert {p.name for p in tmp_path.iterdir()} == set(built)
    metrics = spark.read.json(str(tmp_path / "all_metrics"))
    assert metrics.select("section").distinct().count() == 12
    best = spark.read.json(str(tmp_path / "recoverability_best_probe")).collect()
    assert {r.variant[0] for r in best} == set("ABCDE") and all(0 <= r.auroc <= 1 for r in best)
    rows = spark.read.option("header", True).csv(str(tmp_path / "window_provenance_rows"))
    assert rows.count() == 2 * 18 * rows.select("stay_id").distinct().count()


def test_other_options_do_not_read_old_stages(spark, tmp_path):
    small = ProbeSettings(max_iter=200, folds=3)
    counts = {}
    for offsets in ((0, 1), (0, 1, 2)):
        options = Options(settings=small, probes=("logreg",), offsets=offsets, n_boot=10)
        run_audit(spark, catalog._sources(spark, SF), str(tmp_path / str(len(offsets))), options, "run_test_other", version="tables of the test")
        counts[len(offsets)] = spark.read.json(str(tmp_path / str(len(offsets)) / "control_decay")).count()
    assert counts == {2: 2, 3: 3}
