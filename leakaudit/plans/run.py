"""The whole audit in one call: every table, summary and figure series to a folder."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakaudit.operators import audits, intervals, states
from leakaudit.operators.probes import ProbeSettings, out_of_fold
from leakaudit.plans import audit
from leakaudit.sources import tables

PROBE_NAMES = ("logreg", "rf", "gb")
OFFSETS = (0, 1, 2, 4, 8)


@dataclass(frozen=True)
class Options:
    """Defaults are the full-size audit."""

    settings: ProbeSettings = ProbeSettings()
    probes: Sequence[str] = PROBE_NAMES
    offsets: Sequence[int] = OFFSETS
    n_boot: int = 300
    fit_scope: str = "all"
    min_entities: int = 24  # of a published cell


def build_tables(
    spark: SparkSession, s: audit.Sources, options: Options, name: str, version: str | None = None, fresh: bool = False
) -> Mapping[str, DataFrame]:
    """Result tables by name. Raw events are read once each, into stage tables, and every
    later step - fits, replicates, controls - starts from those.

    Stages hold for these sources and options, or for ``version`` and options if the caller names one: a
    second run, in this session or another, goes on from them unless ``fresh``.
    """
    items = (s.grid, s.vital_items, s.lab_items, s.fio2_items)
    inputs = [version] if version is not None else [s.cohort, s.chart, s.labs, s.intervals]
    key = tables.fingerprint(spark, *inputs, items, options)

    def stage(part: str, build: Callable[[], DataFrame], *partition_by: str) -> DataFrame:
        return tables.stage(spark, f"{name}/{part}", build, *partition_by, key=key, fresh=fresh)

    o, seed = options, options.settings.seed
    hourly = stage("hourly", lambda: audit.measurements_long(s))
    cleaned = stage("intervals", lambda: s.intervals)
    islands = stage("islands", lambda: intervals.interval_union(cleaned, mark_first=True))
    staged = audit.Sources(
        s.cohort, s.chart, s.labs, cleaned, s.grid, s.vital_items, s.lab_items, s.fio2_items
    )
    scored = {w: stage(f"scores_{w}", lambda w=w: audit.scores(staged, w, hourly)) for w in ("short", "long")}

    both = scored["short"].unionByName(scored["long"])
    decomposed = audits.dose_determined(both)
    windows = audits.tagged(
        {
            "before_correction": intervals.window_contamination(islands, s.grid, s.grid.lookback, merged=True),
            "after_correction": intervals.window_contamination(islands, s.grid, s.grid.interval, merged=True),
        }
    )
    provenance = stage("provenance", lambda: windows)

    rows = stage("state_rows", lambda: states.state_rows(scored["short"], audit.labels(staged)))
    state = states.impute_means(rows, states.STATE_FEATURES)
    variants = states.variant_columns()
    probed = state if o.fit_scope == "all" else rows
    table = stage("probe_table", lambda: audit.probe_table(probed, fit_scope=o.fit_scope, settings=o.settings), "fold")
    predictions = stage("predictions", lambda: out_of_fold(table, variants, o.probes, o.settings))
    results = stage("recoverability", lambda: audit.recoverability(predictions, state, variants, o.n_boot, seed))
    best = audit.best_probe(results)

    shuffled = stage("c_shuffled", lambda: audit.shuffled_labels_control(state, stage, o.settings, o.n_boot))
    shifted = audit.decay_predictions(state, stage, o.settings, o.offsets)
    decay = stage("c_decay", lambda: audit.decay_curve(shifted, s.grid.interval, o.n_boot, seed))
    placebo = stage("c_placebo", lambda: audit.placebo_control(state, stage, o.settings, o.n_boot))

    paired = stage("c_decay_paired", lambda: audit.decay_paired(shifted, o.offsets, o.n_boot, seed))

    # What is published of groups leaves out small ones, here and in the consolidated table.
    released = audits.decomposition_released(decomposed, o.min_entities)
    summary, bands, bins = released["summary"], released["by_severity"], released["by_bin"]
    contamination = audits.before_after(provenance, "before_correction", "after_correction")
    bare = best.filter(F.col("variant") == "E_physiology_only").select("probe", "auroc")
    consolidated = audit.consolidated(
        [
            ("score_decomposition", summary, ["window"]),
            ("decomposition_by_severity", bands.drop("band_no"), ["window", "band"]),
            ("decomposition_by_bin", bins, ["window", "bin"]),
            ("recoverability", best, ["variant", "probe"]),
            ("recoverability_gap", audit.recoverability_gap(best), []),
            ("window_audit", contamination, []),
            ("shuffled_labels", shuffled.drop("variant"), ["probe"]),
            ("offset_decay", decay, ["offset_bins"]),
            ("offset_decay_slope", audit.decay_verdict(decay), ["reading"]),
            ("offset_decay_slope", paired, ["verdict"]),
            ("physiology_only_reference", bare, ["probe"]),
            ("placebo", placebo, ["variant", "probe"]),
            ("cohort", audits.prevalence(rows), []),
        ]
    )
    return {
        "score_decomposition_rows": decomposed,
        "score_decomposition_summary": summary,
        "score_decomposition_by_severity": bands,
        "score_decomposition_by_bin": bins,
        "recoverability_full": results,
        "recoverability_best_probe": best,
        "recoverability_error_bars": audit.error_bars(best),
        "window_provenance_rows": provenance,
        "window_audit_summary": contamination,
        "window_histogram": audits.histogram(provenance, "window_condition", "pct_of_window"),
        "control_shuffled": shuffled,
        "control_decay": decay,
        "control_decay_paired": paired,
        "control_placebo": placebo,
        "all_metrics": consolidated,
    }


def run_audit(
    spark: SparkSession,
    s: audit.Sources,
    out: str,
    options: Options = Options(),
    name: str = "audit",
    version: str | None = None,
    fresh: bool = False,
) -> Mapping[str, DataFrame]:
    """Build every table and write it below ``out``: row-level tables as CSV, summaries
    as JSON. Row-level tables carry entity ids and are not for release."""
    built = build_tables(spark, s, options, name, version, fresh)
    for table, df in built.items():
        write = tables.write_rows_csv if table.endswith("_rows") else tables.write_summary_json
        write(df, f"{out}/{table}")
    return built
