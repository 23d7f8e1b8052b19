"""Score tables, state tables, label offsets and feature-set variants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakaudit.functions import rules
from leakaudit.operators.grid import Grid
from leakaudit.operators.intervals import DOSE_SCORED

# Feature names, window statistics and ablations of the audited state.
MEASURED = [
    "heart_rate", "sbp", "dbp", "mbp", "resp_rate", "spo2", "temp_f", "gcs_eye", "gcs_verbal",
    "gcs_motor", "creatinine", "bilirubin_total", "platelets", "wbc", "lactate", "potassium",
    "sodium", "bun", "pao2", "paco2", "ph", "fio2",
]
WORST = {"creatinine": "max", "bilirubin_total": "max", "platelets": "min", "pao2": "min", "fio2": "max"}
SUBSCORES = ["sofa_resp", "sofa_coag", "sofa_liver", "sofa_renal", "sofa_cardio", "sofa_cns"]
OTHER_SUBSCORES = ["sofa_resp", "sofa_coag", "sofa_liver", "sofa_renal", "sofa_cns"]
STATE_FEATURES = [
    "heart_rate", "sbp", "dbp", "mbp", "resp_rate", "spo2", "temp_f",
    "gcs_total", "creatinine", "potassium", "sodium", "bun", "bilirubin_total",
    "platelets", "wbc", "lactate", "ph", "pf_ratio",
    "sofa_resp", "sofa_coag", "sofa_liver", "sofa_renal", "sofa_cns", "sofa_cardio", "sofa_total",
]


def score_table(wide: DataFrame, doses: DataFrame, window: str, key: str = "stay_id") -> DataFrame:
    """Six subscores and their total per (key, bin), the cardiovascular one split into
    what pressure and what dose alone would give. Both windows use the same doses."""
    joined = wide.join(doses, [key, "bin"], "left")
    inputs = {"pf_ratio": rules.ratio("pao2", "fio2"), "gcs_total": rules.coma_total("gcs_eye", "gcs_verbal", "gcs_motor")}
    points = {
        "sofa_resp": rules.respiratory_points("pf_ratio"),
        "sofa_coag": rules.coagulation_points("platelets"),
        "sofa_liver": rules.liver_points("bilirubin_total"),
        "sofa_renal": rules.renal_points("creatinine"),
        "sofa_cns": rules.cns_points("gcs_total"),
        "cardio_score_from_map": rules.pressure_points("mbp"),
        "cardio_score_from_dose": rules.dose_points(*DOSE_SCORED),
    }
    scored = joined.withColumns(inputs).withColumns(points)
    scored = scored.withColumn("sofa_cardio", F.greatest("cardio_score_from_map", "cardio_score_from_dose"))
    return scored.withColumns({"sofa_total": rules.sum_present(*SUBSCORES), "window": F.lit(window)})


def state_rows(
    scores: DataFrame, labels: DataFrame, features: Sequence[str] = STATE_FEATURES, key: str = "stay_id"
) -> DataFrame:
    """Feature columns as doubles with the next-bin label; NULLs still in place."""
    columns = [f"CAST({f if f in scores.columns else 'NULL'} AS DOUBLE) AS {f}" for f in features]
    rows = scores.selectExpr(key, "bin", *columns).join(labels, [key, "bin"])
    return rows.na.drop(subset=["action_next"])


def column_means(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[F.expr(f"avg({c}) AS {c}") for c in columns])


def impute_means(df: DataFrame, columns: Sequence[str], fit: DataFrame | None = None) -> DataFrame:
    """NULLs become the column mean over ``fit`` (the same rows by default).

    The means arrive as a scalar subquery: one struct, computed once.
    """
    means = column_means(df if fit is None else fit, columns).select(F.struct(*columns)).scalar()
    kept = [f"coalesce({c}, __means.{c}) AS {c}" if c in set(columns) else c for c in df.columns]
    return df.withColumn("__means", means).selectExpr(*kept)


def impute_by_fold(df: DataFrame, columns: Sequence[str], fold: str) -> DataFrame:
    """The leak-free option: NULLs become the column mean of the other folds, or stay
    when those have none.

    Sums and counts per fold, added up without the fold itself, serve all folds as one map.
    """
    parts = df.groupBy(fold).agg(*[F.expr(f"named_struct('n', count({c}), 's', sum({c})) AS {c}") for c in columns])
    own = parts.agg(F.map_from_entries(F.collect_list(F.struct(F.col(fold), F.struct(*columns))))).scalar()
    total = "named_struct('n', sum({0}.n), 's', sum({0}.s)) AS {0}"
    every = parts.agg(*[F.expr(total.format(c)) for c in columns]).select(F.struct(*columns)).scalar()
    placed = df.withColumns({"__all": every, "__own": F.element_at(own, F.col(fold))})
    rest = "(coalesce(__all.{0}.s, 0.0D) - coalesce(__own.{0}.s, 0.0D)) / nullif(__all.{0}.n - __own.{0}.n, 0)"
    filled = "coalesce({0}, " + rest + ") AS {0}"
    return placed.selectExpr(*[filled.format(c) if c in set(columns) else c for c in df.columns])


def standardize(df: DataFrame, columns: Sequence[str], fit: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population std over ``fit``; a constant column becomes 0."""
    aggs = [F.expr(f"named_struct('m', avg({c}), 's', stddev_pop({c})) AS {c}") for c in columns]
    scale = (df if fit is None else fit).agg(*aggs).select(F.struct(*columns)).scalar()
    scaled = "({0} - __scale.{0}.m) / CASE WHEN __scale.{0}.s > 0 THEN __scale.{0}.s ELSE 1.0D END AS {0}"
    kept = [scaled.format(c) if c in set(columns) else c for c in df.columns]
    return df.withColumn("__scale", scale).selectExpr(*kept)


def standardize_by_fold(df: DataFrame, columns: Sequence[str], fold: str, k: int) -> DataFrame:
    """The leak-free option: each of the ``k`` folds is scaled with the rows of the others.

    Per-fold counts, sums and sums of squares are added up without the fold itself, so
    one aggregate of ``k`` rows serves all folds; it comes back as a map to look up.
    Sums are taken around the overall mean to keep the variance well conditioned.
    """
    centre = column_means(df, columns).select(F.struct(*columns)).scalar()
    moments = "named_struct('n', count({0}), 's', sum({0} - __c.{0}), 'q', sum(power({0} - __c.{0}, 2))) AS {0}"
    parts = df.withColumn("__c", centre).groupBy(fold).agg(*[F.expr(moments.format(c)) for c in columns])
    own = parts.agg(F.map_from_entries(F.collect_list(F.struct(F.col(fold), F.struct(*columns))))).scalar()
    total = "named_struct('n', sum({0}.n), 's', sum({0}.s), 'q', sum({0}.q)) AS {0}"
    every = parts.agg(*[F.expr(total.format(c)) for c in columns]).select(F.struct(*columns)).scalar()
    placed = df.withColumns({"__c": centre, "__all": every, "__own": F.element_at(own, F.col(fold))})
    rest = {f: "(__all.{0}." + f + " - coalesce(__own.{0}." + f + ", 0))" for f in "nsq"}
    shift = f"({rest['s']} / {rest['n']})"
    std = f"sqrt(greatest({rest['q']} / {rest['n']} - {shift} * {shift}, 0.0D))"
    scaled = f"({{0}} - __c.{{0}} - {shift}) / CASE WHEN {std} > 0 THEN {std} ELSE 1.0D END AS {{0}}"
    return placed.selectExpr(*[scaled.format(c) if c in set(columns) else c for c in df.columns])


def offset_labels(
    state: DataFrame, offset: int, by: str = "row", key: str = "stay_id", label: str = "action_next"
) -> DataFrame:
    """Add ``action_shifted``, the label ``offset`` rows (or bins) further on, dropping
    rows that have none. Counting rows skips bins that are absent from the table.

    (key, bin) is unique here, so a window never holds more rows than the grid has bins.
    """
    if offset == 0:
        return state.withColumn("action_shifted", F.col(label))
    if by == "row":
        ahead = F.lead(label, offset).over(Window.partitionBy(key).orderBy("bin"))
        return state.withColumn("action_shifted", ahead).na.drop(subset=["action_shifted"])
    later = state.select(
        key, (F.col("bin") - F.lit(offset)).alias("bin"), F.col(label).alias("action_shifted")
    )
    return state.join(later, [key, "bin"])


def all_offset_labels(
    state: DataFrame, offsets: Sequence[int], key: str = "stay_id", label: str = "action_next"
) -> DataFrame:
    """``offset_labels`` for several offsets at once, tagged with ``offset_bins``: one window serves them all."""
    ahead = Window.partitionBy(key).orderBy("bin")
    columns = [f"__l{k}" for k in offsets]
    led = state.withColumns({c: F.lead(label, k).over(ahead) for c, k in zip(columns, offsets)})
    pairs = F.array(*[F.struct(F.col(c).alias("action_shifted"), F.lit(k).alias("offset_bins")) for c, k in zip(columns, offsets)])
    return led.select(*state.columns, F.inline(pairs)).filter("action_shifted IS NOT NULL")


# --- variants -----------------------------------------------------------------------

MAP_ONLY_CARDIO = "cardio_map_only"
MAP_ONLY_TOTAL = "total_map_only"


def with_map_only(state: DataFrame) -> DataFrame:
    """Cardiovascular score from pressure alone, and the total rebuilt from it, so that
    the dose cannot be recovered by subtraction."""
    cardio = rules.pressure_points("mbp").cast("double")
    total = F.expr(" + ".join([MAP_ONLY_CARDIO, *OTHER_SUBSCORES]))
    return state.withColumn(MAP_ONLY_CARDIO, cardio).withColumn(MAP_ONLY_TOTAL, total)


def variant_columns(features: Sequence[str] = STATE_FEATURES) -> dict[str, list[str]]:
    """Variants are column lists over one table; no data is copied."""
    features = list(features)

    def without(*names: str) -> list[str]:
        return [f for f in features if f not in names]

    swap = {"sofa_cardio": MAP_ONLY_CARDIO, "sofa_total": MAP_ONLY_TOTAL}
    return {
        "A_full": features,
        "B_no_total_sofa": without("sofa_total"),
        "C_no_cardio_sofa": without("sofa_cardio"),
        "D_treatment_decomposed": [swap.get(f, f) for f in features],
        "E_physiology_only": without("sofa_total", "sofa_cardio"),
    }


def features_long(state: DataFrame, columns: Sequence[str], *keep: str) -> DataFrame:
    """(keep..., feature, value), one row per listed column."""
    pairs = ", ".join(f"named_struct('feature', '{c}', 'value', {c})" for c in columns)
    return state.select(*keep, F.expr(f"inline(array({pairs}))"))


def variant_rows(state: DataFrame, key: str = "stay_id") -> DataFrame:
    """Tall (key, bin, variant, n_features, sofa_cardio, sofa_total) view of what each variant exposes."""
    rows = with_map_only(state)
    out = []
    for name, columns in variant_columns().items():
        shown = {
            "sofa_cardio": next((c for c in columns if c in ("sofa_cardio", MAP_ONLY_CARDIO)), None),
            "sofa_total": next((c for c in columns if c in ("sofa_total", MAP_ONLY_TOTAL)), None),
        }
        out.append(
            F.struct(
                F.lit(name).alias("variant"),
                F.lit(len(columns)).alias("n_features"),
                *[
                    (F.col(c) if c else F.lit(None)).cast("double").alias(role) for role, c in shown.items()
                ],
            )
        )
    return rows.select(key, "bin", F.inline(F.array(*out)))
