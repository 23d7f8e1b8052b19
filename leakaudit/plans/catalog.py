"""Every query by name, run over the test tables: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leakaudit.functions import rules
from leakaudit.functions.hashing import uniform
from leakaudit.functions.elapsed import elapsed_hours, hour_bucket, within_horizon
from leakaudit.operators import audits, clusters, cohort, grid, intervals, logistic, measurements, metrics, resample, states
from leakaudit.operators.probes import ProbeSettings, class_weights, out_of_fold
from leakaudit.operators.quantiles import describe, exact_quantiles
from leakaudit.plans import audit, fixture
from leakaudit.session import configure
from leakaudit.sources.tables import file_facts, fingerprint, optional_table, read_table, run_sql, stage

Query = Callable[[SparkSession, str], DataFrame]

GRID = fixture.GRID
SHORT, LONG = GRID.interval, GRID.lookback
N_BOOT = 300
SWEEP = [6.0, 24.0, 72.0, 100.0, 144.0]
COPIES = [1, 2, 5, 15]
SETTINGS = ProbeSettings()

_QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    """Register under the function's name, less the ``_query`` that tells it from an import."""
    _QUERIES[function.__name__.removesuffix("_query")] = function
    return function


def _tidied(df: DataFrame) -> DataFrame:
    """Doubles at six decimals and times as text, for comparison across engines."""

    def shown(field: T.StructField) -> str:
        c = f"`{field.name}`"
        if isinstance(field.dataType, T.DoubleType):
            return f"round({c}, 6) + 0.0D AS {c}"
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            return f"CAST({c} AS STRING) AS {c}"
        return c

    return df.selectExpr(*[shown(f) for f in df.schema.fields])


def _wrapped(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        return _tidied(function(spark, sf_dir))

    return run


def queries() -> dict[str, Query]:
    return {name: _wrapped(function) for name, function in _QUERIES.items()}


# --- shared inputs ----------------------------------------------------------------------


def _raw_intervals(spark, sf):
    return intervals.infusion_intervals(fixture.infusions(spark, sf), fixture.user_stays(spark, sf), fixture.DRUGS)


def _intervals(spark, sf):
    return intervals.unit_guard(_raw_intervals(spark, sf))


def _sources(spark, sf) -> audit.Sources:
    return audit.Sources(
        cohort=fixture.user_stays(spark, sf),
        chart=fixture.chart_events(spark, sf),
        labs=fixture.lab_events(spark, sf),
        intervals=_intervals(spark, sf),
        grid=GRID,
        vital_items=fixture.VITAL_ITEMS,
        lab_items=fixture.LAB_ITEMS,
        fio2_items=fixture.FIO2_ITEMS,
    )


def _long(spark, sf):
    return audit.measurements_long(_sources(spark, sf))


def _exp1_rows(spark, sf):
    s = _sources(spark, sf)
    both = [audits.dose_determined(audit.scores(s, w)) for w in ("short", "long")]
    return both[0].unionByName(both[1])


def _contamination(spark, sf, width):
    return intervals.window_contamination(_intervals(spark, sf), GRID, width)


def _both_conditions(spark, sf):
    islands = intervals.interval_union(_intervals(spark, sf), mark_first=True)
    return audits.tagged(
        {
            "before_correction": intervals.window_contamination(islands, GRID, LONG, merged=True),
            "after_correction": intervals.window_contamination(islands, GRID, SHORT, merged=True),
        }
    )


def fixed_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """(stay_id, bin, y, score): the share of the current bin under treatment as a score
    for the next bin's action. Full of ties, and the same in any engine."""
    rows = audit.labels(_sources(spark, sf))
    share = _contamination(spark, sf, SHORT).select("stay_id", "bin", F.col("pct_of_window").alias("score"))
    joined = rows.join(share, ["stay_id", "bin"], "left")
    return joined.select(
        "stay_id",
        "bin",
        F.col("action_next").alias("y"),
        F.round(F.coalesce("score", F.lit(0.0)), 9).alias("score"),
    )


def _unimputed(spark, sf):
    s = _sources(spark, sf)
    return states.state_rows(audit.scores(s, "short"), audit.labels(s))


def _stage_for(spark, sf):
    """Stages of these tables as they are now, and of these settings."""
    tables = [(name, size if size else file_facts(spark, f"{sf}/{name}"), time) for name, size, time in file_facts(spark, sf)]
    key = fingerprint(spark, sf, tables, SETTINGS, N_BOOT)
    return lambda name, build, *by: stage(spark, f"catalog/{name}", build, *by, key=key)


# Everything that reads predictions or state rows more than once - sketches, folds,
# replicates, fits - starts from a stage table, so raw events are processed once.


def _staged_predictions(spark, sf):
    return _stage_for(spark, sf)("fixed_predictions", lambda: fixed_predictions(spark, sf))


def _staged_rows(spark, sf):
    return _stage_for(spark, sf)("state_rows", lambda: _unimputed(spark, sf))


def _staged_state(spark, sf):
    return states.impute_means(_staged_rows(spark, sf), states.STATE_FEATURES)


def _staged_table(spark, sf):
    def build():
        return audit.probe_table(_staged_state(spark, sf), settings=SETTINGS)

    return _stage_for(spark, sf)("probe_table", build, "fold")


def _probed(spark, sf, probe):
    """Out-of-fold predictions of all five variants by one probe."""

    def build():
        return out_of_fold(_staged_table(spark, sf), states.variant_columns(), [probe], SETTINGS)

    return _stage_for(spark, sf)(f"oof_{probe}", build)


def _predictions(spark, sf):
    _staged_table(spark, sf)  # what all three start from
    with ThreadPoolExecutor(3) as pool:
        parts = list(pool.map(lambda p: _probed(spark, sf, p), ("logreg", "rf", "gb")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _exp2(spark, sf):
    def build():
        return audit.recoverability(
            _predictions(spark, sf), _staged_state(spark, sf), states.variant_columns(), N_BOOT
        )

    return _stage_for(spark, sf)("exp2_results", build)


# --- cohort -----------------------------------------------------------------------------


@query
def first_qualifying(spark, sf):
    rows = cohort.join_stays(*fixture.cohort_inputs(spark, sf)[:3])
    for _, test in fixture.COHORT_RULE.steps():
        rows = rows.filter(test)
    return cohort.first_qualifying(rows).select("subject_id", "stay_id", "intime", "rn")


@query
def exposure_semi_join(spark, sf):
    stays, _, _, exposures = fixture.cohort_inputs(spark, sf)
    keys = cohort.exposed_keys(exposures, fixture.COHORT_RULE.exposure_items)
    return stays.join(keys, "stay_id", "left_semi").select("stay_id", "subject_id")


COHORT_SHOWN = ["subject_id", "hadm_id", "stay_id", "intime", "los", "first_careunit", "anchor_age",
                "hospital_expire_flag", "rn", "qualifier_applied"]


@query
def cohort_query(spark, sf):
    built = cohort.build_cohort(
        *fixture.cohort_inputs(spark, sf), fixture.COHORT_RULE, fixture.line_qualifier(spark, sf)
    )
    return built.select(*COHORT_SHOWN)


@query
def cohort_fallback(spark, sf):
    """No session has this qualifier table, so the cohort is built without the filter."""
    qualifier = optional_table(spark, "derived_qualifier_absent")
    built = cohort.build_cohort(*fixture.cohort_inputs(spark, sf), fixture.COHORT_RULE, qualifier)
    return built.select(*COHORT_SHOWN)


@query
def cohort_flow(spark, sf):
    return cohort.cohort_flow(
        *fixture.cohort_inputs(spark, sf), fixture.COHORT_RULE, fixture.line_qualifier(spark, sf)
    )


@query
def key_fanout_audit(spark, sf):
    return audits.key_fanout(read_table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


# --- measurements -----------------------------------------------------------------------


@query
def hour_bucket_query(spark, sf):
    rows = measurements.to_origin(fixture.chart_events(spark, sf), fixture.user_stays(spark, sf), "stay_id")
    return rows.select("stay_id", "itemid", "charttime", hour_bucket("intime", "charttime").alias("hour"))


@query
def horizon_filter(spark, sf):
    rows = measurements.to_origin(fixture.chart_events(spark, sf), fixture.user_stays(spark, sf), "stay_id")
    kept = rows.filter(within_horizon("intime", "charttime", GRID.horizon))
    return kept.select("stay_id", "itemid", "charttime", elapsed_hours("intime", "charttime").alias("hours"))


@query
def item_dictionary_join(spark, sf):
    items = fixture.VITAL_ITEMS + fixture.LAB_ITEMS + fixture.FIO2_ITEMS
    labelled = measurements.label_items(fixture.chart_events(spark, sf), items)
    return labelled.select("stay_id", "itemid", "feature", "charttime", "valuenum")


@query
def hourly_vitals(spark, sf):
    return measurements.hourly_means(
        fixture.chart_events(spark, sf), fixture.user_stays(spark, sf), fixture.VITAL_ITEMS, GRID.horizon
    )


@query
def hourly_labs(spark, sf):
    return measurements.hourly_means(
        fixture.lab_events(spark, sf), fixture.user_stays(spark, sf), fixture.LAB_ITEMS, GRID.horizon, "hadm_id"
    )


@query
def fraction_rescale(spark, sf):
    return measurements.hourly_means(
        fixture.chart_events(spark, sf), fixture.user_stays(spark, sf), fixture.FIO2_ITEMS, GRID.horizon
    )


@query
def measurements_long(spark, sf):
    return _long(spark, sf)


@query
def feature_relabel(spark, sf):
    relabelled = measurements.relabel(hourly_vitals(spark, sf), ["mbp", "mbp_arterial"], "mbp")
    return relabelled.filter(F.col("feature") == "mbp")


@query
def feature_relabel_preferred(spark, sf):
    kept = measurements.relabel_preferring(hourly_vitals(spark, sf), ["mbp", "mbp_arterial"], "mbp")
    return kept.filter(F.col("feature") == "mbp")


@query
def parameterized_extract(spark, sf):
    fixture.infusions(spark, sf).createOrReplaceTempView("leakaudit_infusions")
    text = """
        SELECT i.stay_id, i.itemid, i.amount,
               timestampdiff(HOUR, c.intime, i.starttime) AS start_hour
        FROM IDENTIFIER(:source) i JOIN {cohort} c ON i.stay_id = c.stay_id
        WHERE i.amount > :least AND timestampdiff(HOUR, c.intime, i.starttime) BETWEEN 0 AND :horizon
    """
    params = {"source": "leakaudit_infusions", "least": 20.0, "horizon": int(GRID.horizon)}
    return run_sql(spark, text, params, cohort=fixture.user_stays(spark, sf))


@query
def event_share_audit(spark, sf):
    return audits.event_share(fixture.chart_events(spark, sf), [i.itemid for i in fixture.LAB_ITEMS])


@query
def pf_nearest_hour(spark, sf):
    return measurements.nearest_ratio(_long(spark, sf), "pao2", "fio2")


# --- treatment intervals ------------------------------------------------------------------


@query
def infusion_intervals(spark, sf):
    return _raw_intervals(spark, sf)


@query
def unit_guard(spark, sf):
    return _intervals(spark, sf)


@query
def unit_guard_audit(spark, sf):
    return intervals.unit_guard_audit(_raw_intervals(spark, sf))


@query
def drug_counts(spark, sf):
    return intervals.drug_counts(_intervals(spark, sf))


@query
def interval_union(spark, sf):
    return intervals.interval_union(_intervals(spark, sf))


@query
def overlapping_stay_share(spark, sf):
    return intervals.overlapping_share(_intervals(spark, sf))


@query
def decision_grid(spark, sf):
    return grid.decision_grid(fixture.user_stays(spark, sf), GRID)


@query
def window_contamination_long(spark, sf):
    return _contamination(spark, sf, LONG)


@query
def window_contamination_short(spark, sf):
    return _contamination(spark, sf, SHORT)


@query
def window_contamination_observed(spark, sf):
    return intervals.window_contamination(_intervals(spark, sf), GRID, LONG, denominator="observed")


@query
def contamination_sum_based(spark, sf):
    return intervals.window_contamination_summed(_intervals(spark, sf), GRID, LONG)


@query
def contamination_both(spark, sf):
    return _both_conditions(spark, sf)


@query
def contamination_histogram(spark, sf):
    rows = _both_conditions(spark, sf).withColumn("pct_of_window", F.round("pct_of_window", 9))
    return audits.histogram(rows, "window_condition", "pct_of_window")


@query
def exp3_describe(spark, sf):
    return describe(_both_conditions(spark, sf), ["window_condition"], "pct_of_window")


@query
def exp3_summary(spark, sf):
    return audits.before_after(_both_conditions(spark, sf), "before_correction", "after_correction")


@query
def window_sweep(spark, sf):
    return audits.window_sweep(_intervals(spark, sf), GRID, SWEEP)


@query
def fanout_sweep(spark, sf):
    summed = intervals.window_contamination_summed(_intervals(spark, sf), GRID, LONG)
    rows = audits.copies_sweep_rows(summed, LONG, COPIES)
    share = audits.exceedance(rows, ["copies"])
    median = exact_quantiles(rows, ["copies"], "pct_of_window", [0.5])
    return share.join(median.select("copies", F.col("quantile").alias("median_pct")), "copies")


# --- windowed features and scores -----------------------------------------------------------


@query
def windowed_features_short(spark, sf):
    return grid.windowed_features(_long(spark, sf), GRID, SHORT, states.WORST)


@query
def windowed_features_long(spark, sf):
    return grid.windowed_features(_long(spark, sf), GRID, LONG, states.WORST)


@query
def windowed_features_uneven(spark, sf):
    """A window that cuts bins, so points are placed one by one."""
    return grid.windowed_features(_long(spark, sf), GRID, 100.0, states.WORST)


@query
def wide_features(spark, sf):
    return grid.windowed_wide(_long(spark, sf), GRID, LONG, states.WORST, states.MEASURED)


@query
def dose_matrix(spark, sf):
    return intervals.dose_matrix(_intervals(spark, sf), GRID)


def _score_columns(spark, sf, *columns):
    return audit.scores(_sources(spark, sf), "long").select("stay_id", "bin", *columns)


@query
def sofa_resp(spark, sf):
    return _score_columns(spark, sf, "pao2", "fio2", "pf_ratio", "sofa_resp")


@query
def sofa_coag(spark, sf):
    return _score_columns(spark, sf, "platelets", "sofa_coag")


@query
def sofa_liver(spark, sf):
    return _score_columns(spark, sf, "bilirubin_total", "sofa_liver")


@query
def sofa_renal(spark, sf):
    return _score_columns(spark, sf, "creatinine", "sofa_renal")


@query
def sofa_cns(spark, sf):
    return _score_columns(spark, sf, "gcs_eye", "gcs_verbal", "gcs_motor", "gcs_total", "sofa_cns")


@query
def sofa_cardio(spark, sf):
    return _score_columns(
        spark, sf, "mbp", *intervals.DOSE_SCORED, "cardio_score_from_map", "cardio_score_from_dose", "sofa_cardio"
    )


SCORE_SHOWN = ["stay_id", "bin", *states.SUBSCORES, "sofa_total", "window"]


@query
def sofa_scores_short(spark, sf):
    return audit.scores(_sources(spark, sf), "short").select(*SCORE_SHOWN)


@query
def sofa_scores_long(spark, sf):
    return audit.scores(_sources(spark, sf), "long").select(*SCORE_SHOWN)


@query
def exp1_rows(spark, sf):
    return _exp1_rows(spark, sf).select(
        "stay_id", "bin", "window", "cardio_score_from_map", "cardio_score_from_dose", "sofa_total",
        "dose_determined", "treated",
    )


@query
def exp1_summary(spark, sf):
    return audits.decomposition_summary(_exp1_rows(spark, sf))


@query
def exp1_by_severity(spark, sf):
    return audits.by_severity(_exp1_rows(spark, sf))


@query
def exp1_by_bin(spark, sf):
    return audits.by_bin(_exp1_rows(spark, sf))


@query
def invariant_violations(spark, sf):
    scores = audit.scores(_sources(spark, sf), "long")
    sweep = intervals.window_sweep_rows(_intervals(spark, sf), GRID, SWEEP)
    return audits.score_invariants(scores).unionByName(audits.overlap_monotone(sweep))


@query
def aggregate_release(spark, sf):
    rows = _exp1_rows(spark, sf)
    measures = {"pct_dose_determined": F.avg(F.col("dose_determined").cast("double")), "n_rows": F.count(F.lit(1))}
    return audits.aggregate_release(rows, ["window", "bin", "sofa_cardio"], "stay_id", measures)


# --- labels and state -----------------------------------------------------------------------


@query
def action_bins(spark, sf):
    return intervals.action_bins(fixture.user_stays(spark, sf), _intervals(spark, sf), GRID)


@query
def action_labels(spark, sf):
    return audit.labels(_sources(spark, sf))


@query
def impute_means(spark, sf):
    return states.column_means(_unimputed(spark, sf), states.STATE_FEATURES)


@query
def state_table(spark, sf):
    return audit.state(_sources(spark, sf))


@query
def label_prevalence(spark, sf):
    return audits.prevalence(_unimputed(spark, sf))


@query
def offset_labels(spark, sf):
    rows = _staged_rows(spark, sf).select("stay_id", "bin", "action_next")
    return states.all_offset_labels(rows, (1, 2, 4, 8))


@query
def offset_labels_by_bin(spark, sf):
    rows = _staged_rows(spark, sf).select("stay_id", "bin", "action_next")
    return states.offset_labels(rows, 4, by="bin")


@query
def variant_features(spark, sf):
    return states.variant_rows(_staged_state(spark, sf))


@query
def standardize(spark, sf):
    scaled = states.standardize(_staged_state(spark, sf), states.STATE_FEATURES)
    return scaled.select("stay_id", "bin", *states.STATE_FEATURES)


@query
def standardize_within_folds(spark, sf):
    folded = resample.group_folds(_staged_state(spark, sf), 5)
    scaled = states.standardize_by_fold(folded, states.STATE_FEATURES, "fold", 5)
    return scaled.select("stay_id", "bin", "fold", *states.STATE_FEATURES)


@query
def impute_within_folds(spark, sf):
    folded = resample.group_folds(_staged_rows(spark, sf), 5)
    return states.impute_by_fold(folded, states.STATE_FEATURES, "fold").select("stay_id", "bin", "fold", *states.STATE_FEATURES)


@query
def stage_restart(spark, sf):
    """A stage as built, as read back, and under the same name for other input."""
    orders = read_table(spark, sf, "orders").select("o_orderstatus", "o_totalprice")
    dear = orders.filter("o_totalprice > 100000")

    def never():
        raise AssertionError("the stage is there already")

    same, other = fingerprint(spark, orders), fingerprint(spark, dear)
    runs = {
        "built": stage(spark, "restart", lambda: orders, key=same, fresh=True),
        "reread": stage(spark, "restart", never, key=same),
        "changed": stage(spark, "restart", lambda: dear, key=other),
    }
    parts = [df.groupBy(F.lit(run).alias("run"), "o_orderstatus").agg(F.count("*").alias("n_orders")) for run, df in runs.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- resampling and metrics on the fixed score ------------------------------------------------


@query
def group_folds(spark, sf):
    return resample.group_folds(_staged_predictions(spark, sf), 5).select("stay_id", "bin", "fold")


@query
def class_weights_query(spark, sf):
    return class_weights(resample.group_folds(_staged_predictions(spark, sf), 5), k=5)


@query
def label_permutation(spark, sf):
    return resample.permute_label(_staged_predictions(spark, sf).drop("score"), "y", ["stay_id", "bin"])


@query
def within_group_permutation(spark, sf):
    return resample.permute_within(_staged_predictions(spark, sf).drop("score"), "y")


@query
def placebo_column(spark, sf):
    return resample.placebo_column(_staged_predictions(spark, sf).drop("score"), "y", ["stay_id", "bin"])


@query
def auroc(spark, sf):
    return metrics.auroc(_staged_predictions(spark, sf))


@query
def macro_f1(spark, sf):
    return metrics.macro_f1(_staged_predictions(spark, sf))


@query
def balanced_accuracy(spark, sf):
    return metrics.balanced_accuracy(_staged_predictions(spark, sf))


@query
def ece(spark, sf):
    return metrics.calibration_error(_staged_predictions(spark, sf))


@query
def cluster_bootstrap_auroc(spark, sf):
    return metrics.cluster_bootstrap(_staged_predictions(spark, sf), "auroc", n_boot=N_BOOT)


@query
def cluster_bootstrap_metrics(spark, sf):
    """The thresholded metrics under the same replicates."""
    rows = _staged_predictions(spark, sf)
    out = None
    for name in ("macro_f1", "balanced_acc", "ece"):
        part = metrics.cluster_bootstrap(rows, name, n_boot=N_BOOT).withColumnRenamed(name, "estimate")
        part = part.withColumn("metric", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def _paired_predictions(spark, sf):
    base = _staged_predictions(spark, sf)
    near = base.select("stay_id", "y", "score", F.lit(0).alias("offset_bins"))
    far = states.offset_labels(base, 8, label="y").select(
        "stay_id", F.col("action_shifted").alias("y"), "score", F.lit(8).alias("offset_bins")
    )
    return near.unionByName(far)


@query
def cluster_bootstrap_cells(spark, sf):
    """Offsets hold different entities, and each draws from its own."""
    return metrics.cluster_bootstrap(_paired_predictions(spark, sf), "auroc", ["offset_bins"], n_boot=N_BOOT)


@query
def paired_delta_bootstrap(spark, sf):
    return metrics.paired_delta(_paired_predictions(spark, sf), "offset_bins", 0, 8, n_boot=N_BOOT)


@query
def mutual_information(spark, sf):
    y = F.col("action_next").cast("int").alias("y")
    return metrics.mutual_information(states.features_long(_staged_state(spark, sf), states.STATE_FEATURES, y))


@query
def mi_bootstrap(spark, sf):
    y = F.col("action_next").cast("int").alias("y")
    long = states.features_long(_staged_state(spark, sf), states.STATE_FEATURES, "stay_id", y)
    reps = metrics.mutual_information_replicates(long, n_boot=N_BOOT)
    return metrics.percentile_interval(reps, ["feature"])


_FAMILY = ["dopamine", "dobutamine", "epi", "norepi", "cardio_score_from_dose", "cardio_score_from_map", "sofa_total"]


@query
def holm_adjust(spark, sf):
    """Does each column alone rank the next action better than chance, as one family."""

    def build():
        s = _sources(spark, sf)
        return states.state_rows(audit.scores(s, "short"), audit.labels(s), _FAMILY)

    rows = _stage_for(spark, sf)("family_rows", build)
    long = states.features_long(rows, _FAMILY, "stay_id", F.col("action_next").alias("y"))
    long = long.selectExpr("stay_id", "y", "feature", "coalesce(value, 0.0D) AS score")
    return metrics.holm_adjust(audit.family_p_values(long, ["feature"], n_boot=N_BOOT), order=["feature"])


# --- probes -----------------------------------------------------------------------------------


@query
def oof_predictions(spark, sf):
    return _predictions(spark, sf)


@query
def probe_logreg(spark, sf):
    return metrics.auroc(_probed(spark, sf, "logreg"), ["variant", "probe"])


@query
def probe_rf(spark, sf):
    return metrics.auroc(_probed(spark, sf, "rf"), ["variant", "probe"])


@query
def probe_gb(spark, sf):
    return metrics.auroc(_probed(spark, sf, "gb"), ["variant", "probe"])


@query
def exp2_results(spark, sf):
    return _exp2(spark, sf)


@query
def holm_probes(spark, sf):
    """The fifteen variant x probe cells as one family of tests."""
    p_values = audit.family_p_values(_predictions(spark, sf), ["variant", "probe"], n_boot=N_BOOT)
    return metrics.holm_adjust(p_values, order=["variant", "probe"])


# The same summaries over closed-form scores, which any engine can compute.


def _fixed_cells(spark, sf):
    """Two "variants" by two "probes": the treated share and whether there is any, and
    the same of a hash of the row."""
    base = _staged_predictions(spark, sf).withColumn("coin", uniform(resample.SEED, "closed_form", "stay_id", "bin"))
    cells = [("A_full", "logreg", "score"), ("A_full", "rf", "CAST(score > 0 AS DOUBLE)"),
             ("E_physiology_only", "logreg", "coin"), ("E_physiology_only", "rf", "CAST(coin > 0.5 AS DOUBLE)")]
    parts = [base.selectExpr(f"'{v}' AS variant", f"'{p}' AS probe", "stay_id", "y", f"{e} AS score") for v, p, e in cells]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def _fixed_results(spark, sf):
    cells = _stage_for(spark, sf)("fixed_cells", lambda: _fixed_cells(spark, sf))
    found = metrics.cluster_bootstrap(cells, "auroc", ["variant", "probe"], n_boot=N_BOOT).drop("n_reps")
    return found.withColumnsRenamed({"ci_lo": "auroc_ci_lo", "ci_hi": "auroc_ci_hi"})


@query
def best_probe_fixed(spark, sf):
    return audit.best_probe(_fixed_results(spark, sf))


@query
def error_bars_fixed(spark, sf):
    return audit.error_bars(audit.best_probe(_fixed_results(spark, sf)))


@query
def recoverability_gap_fixed(spark, sf):
    return audit.recoverability_gap(audit.best_probe(_fixed_results(spark, sf)))


@query
def decay_fixed(spark, sf):
    return audit.decay_curve(_paired_predictions(spark, sf), GRID.interval, N_BOOT)


@query
def decay_verdict_fixed(spark, sf):
    return audit.decay_verdict(decay_fixed(spark, sf))


@query
def predictions_certificate(spark, sf):
    """Rows scored per variant, probe and fold, and rows that must not be there."""
    rows = resample.group_folds(_predictions(spark, sf), SETTINGS.folds)
    twice = F.count("*") - F.count_distinct("stay_id", "bin")
    outside = F.count_if(~F.col("score").between(0, 1))
    return rows.groupBy("variant", "probe", "fold").agg(F.count("*").alias("n_rows"), twice.alias("n_repeated"), outside.alias("n_outside"))


@query
def fit_certificate(spark, sf):
    """Whether the gradient of every logistic fit's loss, formed anew from the rows, is none at its coefficients."""
    table = _staged_table(spark, sf)
    cells = logistic.cells_of(table, states.variant_columns(), None)
    fits = logistic.fit(table, cells, None, SETTINGS.max_iter)
    told = logistic.certificate(table, cells, fits).join(class_weights(table, k=SETTINGS.folds).filter("y = 1"), "fold")
    return told.select("variant", "fold", "n_train", F.col("n_class").alias("n_positive"), F.col("converged").cast("int").alias("converged"))


@query
def best_probe(spark, sf):
    return audit.best_probe(_exp2(spark, sf))


@query
def recoverability_error_bars(spark, sf):
    return audit.error_bars(audit.best_probe(_exp2(spark, sf)))


@query
def recoverability_gap(spark, sf):
    return audit.recoverability_gap(audit.best_probe(_exp2(spark, sf)))


@query
def control_shuffled(spark, sf):
    return audit.shuffled_labels_control(_staged_state(spark, sf), _stage_for(spark, sf), SETTINGS, N_BOOT)


def _decay(spark, sf):
    return audit.decay_predictions(_staged_state(spark, sf), _stage_for(spark, sf), SETTINGS)


@query
def control_decay(spark, sf):
    return audit.decay_curve(_decay(spark, sf), GRID.interval, N_BOOT)


@query
def control_decay_verdict(spark, sf):
    return audit.decay_verdict(control_decay(spark, sf))


@query
def control_decay_paired(spark, sf):
    return audit.decay_paired(_decay(spark, sf), n_boot=N_BOOT)


def _released(spark, sf, part):
    return audits.decomposition_released(_exp1_rows(spark, sf))[part]


@query
def release_by_severity(spark, sf):
    """Severity bands as published: small ones withheld, with the one that would give them away."""
    return _released(spark, sf, "by_severity")


@query
def release_by_bin(spark, sf):
    return _released(spark, sf, "by_bin")


@query
def control_placebo(spark, sf):
    return audit.placebo_control(_staged_state(spark, sf), _stage_for(spark, sf), SETTINGS, N_BOOT)


def _policy_variants():
    every = states.variant_columns()
    return {v: every[v] for v in ("A_full", "B_no_total_sofa", "D_treatment_decomposed", "E_physiology_only")}


@query
def policy_sensitivity(spark, sf):
    return audit.policy_probe(_staged_table(spark, sf), _policy_variants(), fixture.outcome(spark, sf))


@query
def clustering_certificate(spark, sf):
    """Whether the clustering of every condition has settled, of all rows."""
    table = _staged_table(spark, sf)
    found = clusters.every_start(table, _policy_variants(), ["stay_id", "bin"], 50)
    return audit.clustering_certificate(table, clusters.least_cost(found))


def _table3_counts(spark, sf):
    rows = _exp1_rows(spark, sf)
    both = _both_conditions(spark, sf)
    return [
        ("score_decomposition", audits.decomposition_summary(rows), ["window"]),
        ("decomposition_by_severity", audits.by_severity(rows).drop("band_no"), ["window", "band"]),
        ("window_audit", audits.before_after(both, "before_correction", "after_correction"), []),
        ("cohort", audits.prevalence(_unimputed(spark, sf)), []),
    ]


@query
def table3_counts(spark, sf):
    """The part of the consolidated table that needs no fitted model."""
    return audit.consolidated(_table3_counts(spark, sf))


@query
def table3(spark, sf):
    exp2 = _exp2(spark, sf)
    best = audit.best_probe(exp2)
    bare = best.filter(F.col("variant") == "E_physiology_only").select("probe", "auroc")
    parts = _table3_counts(spark, sf) + [
        ("recoverability", best, ["variant", "probe"]),
        ("recoverability_gap", audit.recoverability_gap(best), []),
        ("shuffled_labels", control_shuffled(spark, sf).drop("variant"), ["probe"]),
        ("offset_decay", control_decay(spark, sf), ["offset_bins"]),
        ("offset_decay_slope", control_decay_verdict(spark, sf), ["reading"]),
        ("offset_decay_slope", control_decay_paired(spark, sf), ["verdict"]),
        ("physiology_only_reference", bare, ["probe"]),
        ("placebo", control_placebo(spark, sf), ["variant", "probe"]),
    ]
    return audit.consolidated(parts)
