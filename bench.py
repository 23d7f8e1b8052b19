"""Time the headline queries on ``local[$BENCH_CPUS]`` over ``$BENCH_SF_DIR``.

Every timing covers building the plan, running it and writing every row and column to
the no-op sink. Stage tables are made fresh for the run and timed under their own
names (``stage_*``); queries that read them come after. ``BENCH_FULL=1`` adds the
forests, boosted trees, controls and the consolidated table: tens of minutes.
"""

from __future__ import annotations

import json
import os
import tempfile
import time
from dataclasses import asdict
from pathlib import PurePath

from pyspark.sql import SparkSession

from leakaudit import configure
from leakaudit.plans import catalog

HEADLINE = [
    "cohort",
    "cohort_flow",
    "key_fanout_audit",
    "hourly_vitals",
    "measurements_long",
    "pf_nearest_hour",
    "infusion_intervals",
    "interval_union",
    "overlapping_stay_share",
    "window_contamination_long",
    "window_contamination_short",
    "contamination_sum_based",
    "contamination_both",
    "contamination_histogram",
    "exp3_describe",
    "exp3_summary",
    "window_sweep",
    "fanout_sweep",
    "windowed_features_short",
    "windowed_features_long",
    "wide_features",
    "dose_matrix",
    "sofa_scores_short",
    "sofa_scores_long",
    "exp1_summary",
    "exp1_by_severity",
    "invariant_violations",
    "aggregate_release",
    "action_labels",
    "state_table",
]
STAGES = {"stage_predictions": "_staged_predictions", "stage_state": "_staged_state", "stage_probe_table": "_staged_table"}
STAGED = [
    "standardize",
    "label_permutation",
    "placebo_column",
    "auroc",
    "ece",
    "mutual_information",
    "cluster_bootstrap_auroc",
    "paired_delta_bootstrap",
    "mi_bootstrap",
    "cluster_bootstrap_cells",
    "impute_within_folds",
    "holm_adjust",
    "probe_logreg",
    "fit_certificate",
    "control_shuffled",
    "control_decay",
    "control_placebo",
]
FULL = ["probe_rf", "probe_gb", "exp2_results", "holm_probes", "policy_sensitivity", "table3"]


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    built = catalog.queries()
    run(built["decision_grid"](spark, sf_dir))  # start-up is not part of any query
    seconds: dict[str, float] = {}

    def timed(name: str, action) -> None:
        start = time.perf_counter()
        action()
        seconds[name] = round(time.perf_counter() - start, 3)

    for name in HEADLINE:
        timed(name, lambda name=name: run(built[name](spark, sf_dir)))
    for name, function in STAGES.items():
        timed(name, lambda function=function: run(getattr(catalog, function)(spark, sf_dir)))
    for name in STAGED + (FULL if os.environ.get("BENCH_FULL") == "1" else []):
        timed(name, lambda name=name: run(built[name](spark, sf_dir)))
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "settings": {"probes": asdict(catalog.SETTINGS), "replicates": catalog.N_BOOT, "state_rows": catalog._staged_rows(spark, sf_dir).count()},
                "sf": PurePath(sf_dir).name.removeprefix("sf"),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
