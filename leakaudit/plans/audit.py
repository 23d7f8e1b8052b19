"""The audit pipeline on any sources: measurements, scores, state, recoverability, controls."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakaudit.operators import clusters, intervals, measurements, metrics, states
from leakaudit.operators.grid import Grid, windowed_wide
from leakaudit.operators.probes import ProbeSettings, out_of_fold
from leakaudit.operators.resample import SEED, bootstrap_vectors, group_folds, permute_label, placebo_column
from leakaudit.sources.tables import scratch_table

Stage = Callable[..., DataFrame]


@dataclass(frozen=True)
class Sources:
    """What an audit reads: the cohort, coded events and cleaned treatment intervals."""

    cohort: DataFrame
    chart: DataFrame
    labs: DataFrame
    intervals: DataFrame
    grid: Grid
    vital_items: Sequence[measurements.Item]
    lab_items: Sequence[measurements.Item]
    fio2_items: Sequence[measurements.Item]


def measurements_long(s: Sources) -> DataFrame:
    """All hourly features. Vitals and inspired oxygen share one pass over the chart."""
    chart_items = [*s.vital_items, *s.fio2_items]
    charted = measurements.hourly_means(s.chart, s.cohort, chart_items, s.grid.horizon)
    labs = measurements.hourly_means(s.labs, s.cohort, s.lab_items, s.grid.horizon, key="hadm_id")
    return measurements.relabel(charted.unionByName(labs), ["mbp", "mbp_arterial"], "mbp")


def scores(s: Sources, window: str, long: DataFrame | None = None) -> DataFrame:
    """Score table of the ``short`` (one bin) or ``long`` (lookback) window."""
    width = s.grid.interval if window == "short" else s.grid.lookback
    wide = windowed_wide(long if long is not None else measurements_long(s), s.grid, width, states.WORST, states.MEASURED)
    return states.score_table(wide, intervals.dose_matrix(s.intervals, s.grid), window)


def labels(s: Sources) -> DataFrame:
    return intervals.next_action(intervals.action_bins(s.cohort, s.intervals, s.grid))


def state(s: Sources, window: str = "short") -> DataFrame:
    """Mean-imputed feature table with the next-bin label."""
    rows = states.state_rows(scores(s, window), labels(s))
    return states.impute_means(rows, states.STATE_FEATURES)


PROBE_COLUMNS = [*states.STATE_FEATURES, states.MAP_ONLY_CARDIO, states.MAP_ONLY_TOTAL]


def probe_table(
    rows: DataFrame,
    label: str = "action_next",
    extra: Sequence[str] = (),
    fit_scope: str = "all",
    settings: ProbeSettings = ProbeSettings(),
) -> DataFrame:
    """Keys, ``fold``, ``y`` and every variant's columns, standardised once for all
    variants. Stage it partitioned by ``fold``, so that a fit reads only its folds.

    ``fit_scope="all"`` scales over all rows, held-out ones included; ``"fold"`` fills and
    scales each fold by the others, from rows with their NULLs. A column without any value becomes constant.
    """
    columns = [*PROBE_COLUMNS, *extra]
    folded = group_folds(rows, settings.folds, "stay_id", settings.seed)
    if fit_scope == "all":
        scaled = states.standardize(states.with_map_only(folded), columns)
    else:
        filled = states.impute_by_fold(folded, states.STATE_FEATURES, "fold")
        scaled = states.standardize_by_fold(states.with_map_only(filled), columns, "fold", settings.folds)
    present = [f"coalesce({c}, 0.0D) AS {c}" for c in columns]
    return scaled.selectExpr("stay_id", "bin", f"CAST({label} AS INT) AS y", *present, "fold")


def recoverability(
    predictions: DataFrame,
    state_table: DataFrame,
    variants: Mapping[str, Sequence[str]],
    n_boot: int = 300,
    seed: int = SEED,
) -> DataFrame:
    """One row per variant and probe: AUROC with its interval, macro F1, balanced
    accuracy, calibration error, and the variant's mean mutual information with its."""
    cell = ["variant", "probe"]
    out = metrics.cluster_bootstrap(predictions, "auroc", cell, n_boot=n_boot, seed=seed).drop("n_reps")
    out = out.withColumnsRenamed({"ci_lo": "auroc_ci_lo", "ci_hi": "auroc_ci_hi"})
    for metric in (metrics.macro_f1, metrics.balanced_accuracy, metrics.calibration_error):
        out = out.join(metric(predictions, cell), cell)
    return out.join(variant_information(state_table, variants, n_boot, seed), "variant")


def variant_information(
    state_table: DataFrame, variants: Mapping[str, Sequence[str]], n_boot: int = 300, seed: int = SEED
) -> DataFrame:
    """(variant, mutual_info, mutual_info_ci_lo, mutual_info_ci_hi): mean over the variant's columns, and the interval of
    that mean. A column's value does not depend on the variant, so each is computed once."""
    rows = states.features_long(
        states.with_map_only(state_table), PROBE_COLUMNS, "stay_id", F.col("action_next").cast("int").alias("y")
    )
    pairs = [(v, c) for v, columns in variants.items() for c in columns]
    members = F.broadcast(measurements.literal_table(state_table.sparkSession, ["variant", "feature"], pairs))
    counts = scratch_table(metrics.binned_counts(rows), "binned_counts")
    weighted = counts.withColumnRenamed("copies", "weight")
    point = metrics.mutual_information_by_feature(weighted).join(members, "feature").groupBy("variant").agg(F.avg("mi").alias("mutual_info"))
    vectors = bootstrap_vectors(state_table.select("stay_id").distinct(), n_boot, seed=seed)
    drawn = metrics.replicates_of_counts(counts, vectors, n_boot).join(members, "feature")
    interval = metrics.percentile_interval(drawn.groupBy("variant", "rep").agg(F.avg("value").alias("value")), ["variant"])
    ends = interval.select("variant", F.col("ci_lo").alias("mutual_info_ci_lo"), F.col("ci_hi").alias("mutual_info_ci_hi"))
    return point.join(ends, "variant")


def best_probe(results: DataFrame, order: Sequence[str] = ("logreg", "rf", "gb")) -> DataFrame:
    """Each variant's probe of highest AUROC, the first in probe order on a tie."""
    rest = [c for c in results.columns if c != "variant"]
    place = F.array_position(F.array(*[F.lit(p) for p in order]), F.col("probe"))
    best = F.min_by(F.struct(*rest), F.struct(-F.col("auroc"), F.when(place > 0, place).otherwise(len(order) + 1), "probe"))
    return results.groupBy("variant").agg(best.alias("b")).select("variant", "b.*")


def recoverability_gap(best: DataFrame, full: str = "A_full", bare: str = "E_physiology_only") -> DataFrame:
    def of(variant: str):
        return F.max(F.when(F.col("variant") == variant, F.col("auroc")))

    return best.agg(
        of(full).alias("auroc_full"), of(bare).alias("auroc_bare"), (of(full) - of(bare)).alias("gap")
    )


# --- negative controls --------------------------------------------------------------------


def _named(part: str, *options: object) -> str:
    """A stage's name for these options; the caller's stage stands for the input."""
    return f"{part}_{hashlib.sha256(repr(options).encode()).hexdigest()[:8]}"


def _interval_row(predictions: DataFrame, by: Sequence[str], n_boot: int, seed: int) -> DataFrame:
    """Every cell draws from its own entities: offsets and variants may hold different ones."""
    return metrics.cluster_bootstrap(predictions, "auroc", by, n_boot=n_boot, seed=seed).drop("n_reps")


def shuffled_labels_control(
    state_table: DataFrame, stage: Stage, settings: ProbeSettings, n_boot: int = 300
) -> DataFrame:
    """AUROC of the full state against permuted labels; about a half if nothing leaks."""
    shuffled = stage(_named("shuffled_labels", settings), lambda: permute_label(state_table, "action_next", ["stay_id", "bin"], settings.seed))
    table = stage(_named("shuffled", settings), lambda: probe_table(shuffled, "y_shuffled", settings=settings), "fold")
    full = {"A_full": states.variant_columns()["A_full"]}
    predictions = stage(_named("shuffled_oof", settings), lambda: out_of_fold(table, full, ["logreg"], settings))
    return _interval_row(predictions, ["variant", "probe"], n_boot, settings.seed)


def decay_predictions(
    state_table: DataFrame, stage: Stage, settings: ProbeSettings, offsets: Sequence[int] = (0, 1, 2, 4, 8)
) -> DataFrame:
    """Refitted predictions of the label each offset ahead, tagged with ``offset_bins``."""
    full = {"A_full": states.variant_columns()["A_full"]}

    def labelled(k: int) -> DataFrame:
        rows = probe_table(states.offset_labels(state_table, k), "action_shifted", settings=settings)
        return rows.withColumn("offset_bins", F.lit(k))

    def build() -> DataFrame:
        name = _named("decay_tables", settings, tuple(offsets))
        table = stage(name, lambda: reduce(DataFrame.unionByName, [labelled(k) for k in offsets]), "fold")
        return out_of_fold(table, full, ["logreg"], settings, part="offset_bins")

    return stage(_named("decay_oof", settings, tuple(offsets)), build)


def decay_curve(predictions: DataFrame, interval: float, n_boot: int = 300, seed: int = SEED) -> DataFrame:
    cell = ["offset_bins"]
    curve = _interval_row(predictions, cell, n_boot, seed)
    sizes = predictions.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    return curve.join(sizes, cell).withColumn("offset_hours", F.col("offset_bins") * F.lit(float(interval)))


def decay_verdict(curve: DataFrame, threshold: float = 0.10) -> DataFrame:
    """AUROC lost from the first to the last offset, and what that speaks for."""
    first, last = F.min_by("auroc", "offset_bins"), F.max_by("auroc", "offset_bins")
    kind = F.when(first - last < threshold, F.lit("persistence")).otherwise(F.lit("specific"))
    return curve.agg((first - last).alias("decay"), kind.alias("reading"))


def decay_paired(predictions: DataFrame, offsets: Sequence[int] = (0, 1, 2, 4, 8), n_boot: int = 300, seed: int = SEED) -> DataFrame:
    """The registered test on the fitted offsets: AUROC of the first minus the last on the same drawn entities, with interval and verdict."""
    return metrics.paired_delta(predictions, "offset_bins", min(offsets), max(offsets), n_boot=n_boot, seed=seed)


def placebo_control(
    state_table: DataFrame, stage: Stage, settings: ProbeSettings, n_boot: int = 300
) -> DataFrame:
    """The bare state with and without a label-prevalence coin, under the same probe."""
    rows = placebo_column(state_table, "action_next", ["stay_id", "bin"], settings.seed)
    bare = states.variant_columns()["E_physiology_only"]
    table = stage(_named("placebo", settings), lambda: probe_table(rows, extra=["placebo"], settings=settings), "fold")
    both = {"E_physiology_only": bare, "E_with_placebo": [*bare, "placebo"]}
    predictions = stage(_named("placebo_oof", settings), lambda: out_of_fold(table, both, ["logreg"], settings))
    return _interval_row(predictions, ["variant", "probe"], n_boot, settings.seed)


# --- policy sensitivity -------------------------------------------------------------------


def best_clustering(rows: DataFrame, clusters: int, starts: int = 10, rounds: int = 300, seed: int = SEED) -> KMeansModel:
    """The k-means model of least cost among ``starts`` seeded ones, of the vectors in column ``x``."""
    best = None
    for start in range(starts):
        model = KMeans(featuresCol="x", predictionCol="cluster", k=clusters, maxIter=rounds, seed=seed + start).fit(rows)
        if model.summary.numIter >= rounds:
            raise RuntimeError(f"k-means start {start}: no convergence in {rounds} iterations")
        if best is None or model.summary.trainingCost < best.summary.trainingCost:
            best = model
    return best


def policy_sensitivity(
    table: DataFrame,
    variants: Mapping[str, Sequence[str]],
    rewards: DataFrame,
    clusters: int = 50,
    rounds: int = 100,
    seed: int = SEED,
    starts: int = 10,
    cluster_rounds: int = 300,
) -> DataFrame:
    """(variant, greedy_action_rate, q_gap_mean): states clustered, reward regressed on
    (cluster, action), greedy action read off. A probe of sensitivity, not of a policy.

    ``rewards`` gives one value per entity, repeated over its bins. One MLlib fit per variant and start; kept to compare
    ``policy_probe`` with.
    """
    rows = table.join(rewards, "stay_id")
    out = None
    for name, columns in variants.items():
        assembled = VectorAssembler(inputCols=list(columns), outputCol="x").transform(rows)
        clustering = best_clustering(assembled, clusters, starts, cluster_rounds, seed)
        placed = clustering.transform(assembled).select("cluster", F.col("y").cast("double").alias("a"), "reward")
        pair = VectorAssembler(inputCols=["cluster", "a"], outputCol="sa")
        model = GBTRegressor(
            featuresCol="sa", labelCol="reward", predictionCol="q", maxIter=rounds, maxDepth=3, stepSize=0.1, seed=seed
        ).fit(pair.transform(placed))
        # At most one row per cluster is scored under either action, then weighted.
        sizes = placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
        asked = sizes.select("cluster", "n", F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("a"))
        q = model.transform(pair.transform(asked)).groupBy("cluster", "n").agg(
            (F.max(F.when(F.col("a") == 1, F.col("q"))) - F.max(F.when(F.col("a") == 0, F.col("q")))).alias("gap")
        )
        part = q.agg(
            F.lit(name).alias("variant"),
            (F.sum(F.when(F.col("gap") > 0, F.col("n")).otherwise(0)) / F.sum("n")).alias("greedy_action_rate"),
            (F.sum(F.col("gap") * F.col("n")) / F.sum("n")).alias("q_gap_mean"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def policy_cells(table: DataFrame, chosen: Sequence[clusters.Clustering], rewards: DataFrame) -> DataFrame:
    """(variant, cluster, y, n, reward): the rows and mean reward of each cluster and action, of rows with a reward. All that
    least squares on (cluster, action) sees, and at most two rows per cluster."""
    placed = clusters.assigned(table, chosen, ["stay_id", "y"]).join(rewards.filter("reward IS NOT NULL"), "stay_id")
    return placed.groupBy("variant", "cluster", "y").agg(F.count(F.lit(1)).alias("n"), F.avg("reward").alias("reward"))


def policy_of_cells(cells: DataFrame, rounds: int = 100) -> DataFrame:
    """(variant, greedy_action_rate, q_gap_mean) of ``policy_cells``: boosted trees on (cluster, action) valued under either
    action in every cluster, weighted by its rows. A variant's cells, twice its clusters at most, are one group."""

    def of(table: pa.Table) -> pa.Table:
        table = table.sort_by([("cluster", "ascending"), ("y", "ascending")])
        cluster, y, n, reward = (table.column(c).to_numpy().astype(float) for c in ("cluster", "y", "n", "reward"))
        each, place = np.unique(cluster, return_inverse=True)
        size = np.bincount(place, n)
        asked = np.concatenate([np.column_stack([each, np.full(len(each), a)]) for a in (0.0, 1.0)])
        q = clusters.boosted_values(np.column_stack([cluster, y]), n, reward, asked, rounds)
        gap = q[len(each) :] - q[: len(each)]
        rate, mean = (size * (gap > 0)).sum() / size.sum(), (size * gap).sum() / size.sum()
        names = ["variant", "greedy_action_rate", "q_gap_mean"]
        return pa.table([[table.column("variant")[0].as_py()], [float(rate)], [float(mean)]], names=names)

    return cells.groupBy("variant").applyInArrow(of, "variant string, greedy_action_rate double, q_gap_mean double")


def policy_probe(
    table: DataFrame,
    variants: Mapping[str, Sequence[str]],
    rewards: DataFrame,
    n_clusters: int = 50,
    rounds: int = 100,
    seed: int = SEED,
    starts: int = 10,
    cluster_rounds: int = 300,
) -> DataFrame:
    """The columns of ``policy_sensitivity``, all variants and starts clustered in shared passes; ``table`` is a stage table.

    Clusters come from all rows with a reward. Trees cut cluster numbers between any two; the MLlib ones use 32 bins."""
    rows = table.join(rewards.filter("reward IS NOT NULL"), "stay_id", "left_semi")
    found = clusters.every_start(rows, variants, ["stay_id", "bin"], n_clusters, starts, cluster_rounds, seed)
    return policy_of_cells(policy_cells(rows, clusters.least_cost(found), rewards), rounds)


def clustering_certificate(
    table: DataFrame, chosen: Sequence[clusters.Clustering], tolerance: float = 2 * clusters.TOLERANCE
) -> DataFrame:
    """(variant, n_rows, n_treated, settled): whether every centre is the mean of the rows nearest to it, formed anew from the rows."""
    shared = {c.variant: c for c in chosen}
    columns = list(dict.fromkeys(c for model in chosen for c in model.columns))
    placed = clusters.assigned(table, chosen, ["y", *columns])
    means = placed.groupBy("variant", "cluster").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("y").cast("long")).alias("treated"), *[F.avg(F.coalesce(c, F.lit(0.0))).alias(c) for c in columns]
    )
    centres = [
        (v, k, *[float(m.centres[k][m.columns.index(c)]) if c in m.columns else None for c in columns])
        for v, m in shared.items() for k in range(len(m.centres))
    ]
    own = table.sparkSession.createDataFrame(centres, "variant string, cluster int, " + ", ".join(f"own_{c} double" for c in columns))
    apart = sum((F.coalesce(F.pow(F.col(c) - F.col(f"own_{c}"), 2), F.lit(0.0)) for c in columns), F.lit(0.0))
    told = means.join(own, ["variant", "cluster"]).withColumn("apart", F.sqrt(apart))
    settled = (F.max("apart") <= tolerance).cast("int")
    return told.groupBy("variant").agg(F.sum("n").alias("n_rows"), F.sum("treated").alias("n_treated"), settled.alias("settled"))


# --- consolidated table -------------------------------------------------------------------


def tidy(df: DataFrame, section: str, keys: Sequence[str] = ()) -> DataFrame:
    """(section, key, metric, value) rows from every numeric column of a summary."""
    numeric = ("double", "bigint", "int", "float")
    values = [c for c, t in df.dtypes if t in numeric and c not in keys]
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in values])
    key = F.concat_ws("/", *[F.col(k).cast("string") for k in keys]) if keys else F.lit("")
    return df.select(F.lit(section).alias("section"), key.alias("key"), F.inline(pairs))


def consolidated(parts: Sequence[tuple[str, DataFrame, Sequence[str]]]) -> DataFrame:
    """All summaries as one tidy table."""
    out = None
    for section, df, keys in parts:
        rows = tidy(df, section, keys)
        out = rows if out is None else out.unionByName(rows)
    return out


def error_bars(best: DataFrame) -> DataFrame:
    """Figure data: AUROC and the two bar lengths per variant, in the fixed order."""
    return best.select(
        "variant",
        "probe",
        "auroc",
        (F.col("auroc") - F.col("auroc_ci_lo")).alias("bar_below"),
        (F.col("auroc_ci_hi") - F.col("auroc")).alias("bar_above"),
    )


def family_p_values(
    predictions: DataFrame, by: Sequence[str], n_boot: int = 300, group: str = "stay_id", seed: int = SEED
) -> DataFrame:
    """(by..., p_value): one-sided bootstrap p-value of AUROC > 1/2 per cell."""
    reps = metrics.bootstrap_replicates(predictions, "auroc", by, n_boot, group, seed)
    short = F.count_if(F.round("value", 9) <= 0.5)
    return reps.groupBy(*by).agg(((short + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"))


