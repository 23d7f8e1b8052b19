"""The audits proper: score decomposition, window summaries, diagnostics, release guard."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakaudit.functions import rules
from leakaudit.operators.grid import Grid
from leakaudit.operators.intervals import DOSE_SCORED, window_sweep_rows
from leakaudit.operators.states import OTHER_SUBSCORES, SUBSCORES

# Right-closed severity bands of the total score.
SEVERITY_BANDS = [(-1, 5), (5, 10), (10, 15), (15, 24)]


# --- score decomposition ---------------------------------------------------------------


def dose_determined(scores: DataFrame) -> DataFrame:
    """Add whether dose, not pressure, set the cardiovascular score, and whether any
    scored drug was running."""
    rows = scores.na.drop(subset=["sofa_cardio"])
    return rows.withColumn(
        "dose_determined", F.col("cardio_score_from_dose") > F.col("cardio_score_from_map")
    ).withColumn("treated", rules.any_positive(*DOSE_SCORED))


def _share(flag: str = "dose_determined") -> Column:
    return F.avg(F.col(flag).cast("double"))


def decomposition_summary(rows: DataFrame) -> DataFrame:
    treated = F.when(F.col("treated"), F.col("dose_determined").cast("double"))
    return rows.groupBy("window").agg(
        F.count(F.lit(1)).alias("n_timesteps"),
        _share().alias("pct_dose_determined_all"),
        F.avg(treated).alias("pct_dose_determined_treated_only"),
        F.avg("cardio_score_from_dose").alias("mean_dose_attributable_points"),
    )


def by_severity(rows: DataFrame, bands: Sequence[tuple[int, int]] = SEVERITY_BANDS) -> DataFrame:
    """Share per severity band; a band nobody falls in is listed with NULL.

    Each band is a conditional aggregate, so empty ones come out without a join.
    """
    total = F.col("sofa_total")

    def inside(lo: int, hi: int) -> Column:
        return (total > lo) & (total <= hi)

    aggs = []
    for i, (lo, hi) in enumerate(bands):
        aggs.append(F.count_if(inside(lo, hi)).alias(f"n{i}"))
        aggs.append(F.avg(F.when(inside(lo, hi), F.col("dose_determined").cast("double"))).alias(f"s{i}"))
    listed = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("band_no"),
                F.lit(f"({lo}, {hi}]").alias("band"),
                F.col(f"n{i}").alias("n"),
                F.col(f"s{i}").alias("pct_dose_determined"),
            )
            for i, (lo, hi) in enumerate(bands)
        ]
    )
    return rows.groupBy("window").agg(*aggs).select("window", F.inline(listed))


def by_bin(rows: DataFrame) -> DataFrame:
    return rows.groupBy("window", "bin").agg(
        F.count(F.lit(1)).alias("n"), _share().alias("pct_dose_determined")
    )


# --- window contamination --------------------------------------------------------------


def tagged(conditions: Mapping[str, DataFrame]) -> DataFrame:
    """Union of like tables, each row carrying its condition's name."""
    out = None
    for tag, df in conditions.items():
        rows = df.withColumn("window_condition", F.lit(tag))
        out = rows if out is None else out.unionByName(rows)
    return out


def exceedance(rows: DataFrame, by: Sequence[str], threshold: float = 0.5) -> DataFrame:
    over = (F.col("pct_of_window") > threshold).cast("double")
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("pct_of_window").alias("mean_pct"),
        F.avg(over).alias("pct_over_threshold"),
    )


def before_after(both: DataFrame, before: str, after: str, threshold: float = 0.5) -> DataFrame:
    """One row: share of decision points over the threshold in either condition, and
    what is left after the correction. No direction is assumed."""
    over = (F.col("pct_of_window") > threshold).cast("double")

    def share(tag: str) -> Column:
        return F.avg(F.when(F.col("window_condition") == tag, over))

    return both.agg(
        share(before).alias("pct_gt50_before"),
        share(after).alias("pct_gt50_after"),
        share(after).alias("residual_after_correction"),
    )


def histogram(rows: DataFrame, by: str, value: str, n_bins: int = 30) -> DataFrame:
    """(by, bin_no, bin_lo, bin_hi, n): equal-width bins over each series' own range, the
    last one closed; empty bins are listed.

    A figure has a handful of series, so their ranges travel as one scalar and the rows
    are never shuffled to meet them; empty bins come from the range table itself.
    """
    span = rows.groupBy(by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    # A series without spread gets a unit-wide range around its value.
    span = span.selectExpr(
        by, "CASE WHEN lo = hi THEN lo - 0.5D ELSE lo END AS lo", "CASE WHEN lo = hi THEN hi + 0.5D ELSE hi END AS hi"
    )
    ranges = span.agg(F.map_from_entries(F.collect_list(F.struct(F.col(by), F.struct("lo", "hi"))))).scalar()
    placed = rows.select(by, F.col(value).alias("x"), ranges.alias("r")).selectExpr(by, "x", f"r[{by}] AS r")
    place = f"CAST(least(floor((x - r.lo) / ((r.hi - r.lo) / {n_bins})), {n_bins - 1}) AS INT) AS bin_no"
    counts = placed.selectExpr(by, place).groupBy(by, "bin_no").agg(F.count(F.lit(1)).alias("n"))
    bins = span.selectExpr("*", f"explode(sequence(0, {n_bins - 1})) AS bin_no", f"(hi - lo) / {n_bins} AS width")
    return bins.join(counts, [by, "bin_no"], "left").selectExpr(
        by, "bin_no", "lo + bin_no * width AS bin_lo", "lo + (bin_no + 1) * width AS bin_hi", "coalesce(n, 0L) AS n"
    )


def window_sweep(
    intervals: DataFrame, grid: Grid, widths: Sequence[float], key: str = "stay_id", merged: bool = False
) -> DataFrame:
    """Mean overlap hours, mean share and exceedance per window width."""
    rows = window_sweep_rows(intervals, grid, widths, key, merged)
    return rows.groupBy("width").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("contaminated_hours").alias("mean_hours"),
        F.avg("pct_of_window").alias("mean_pct"),
        F.avg((F.col("pct_of_window") > 0.5).cast("double")).alias("pct_gt50"),
    )


def copies_sweep_rows(summed: DataFrame, width: float, copies: Sequence[int]) -> DataFrame:
    """Sum-based shares if every interval were stored N times. N copies of every
    interval make N times the hours, so nothing is actually copied."""
    each = summed.withColumn("copies", F.explode(F.array(*[F.lit(int(n)) for n in copies])))
    return each.withColumn(
        "pct_of_window", F.least(F.lit(1.0), F.col("contaminated_hours") * F.col("copies") / F.lit(float(width)))
    )


# --- data-quality diagnostics ------------------------------------------------------------


def key_fanout(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows against distinct keys. Counting per key first keeps it one pass, with copies
    of a key merged before they are shuffled."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.sum("n").alias("n_rows"),
        F.count(F.lit(1)).alias("n_keys"),
        F.max("n").alias("max_copies"),
        F.count_if(F.col("n") > 1).alias("n_repeated_keys"),
        (F.sum("n") / F.count(F.lit(1))).alias("fanout"),
    )


def event_share(events: DataFrame, items: Sequence[int]) -> DataFrame:
    """Share of all events that carry a listed item."""
    listed = F.coalesce(F.col("itemid").isin(list(items)), F.lit(False))
    return events.agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count_if(listed).alias("n_listed"),
        F.avg(listed.cast("double")).alias("share_listed"),
    )


def prevalence(state: DataFrame, label: str = "action_next", key: str = "stay_id") -> DataFrame:
    """Rows, entities and label rate. Rows are first summed per entity, so the distinct
    count costs no expansion."""
    y = F.col(label).cast("double")
    per = state.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("p"))
    return per.agg(
        F.count(F.lit(1)).alias("n_entities"),
        F.sum("n").alias("n_rows"),
        (F.sum("p") / F.sum("n")).alias("positive_rate"),
    )


def score_invariants(scores: DataFrame, map_values: Sequence[float] = (40.0, 55.0, 70.0, 90.0)) -> DataFrame:
    """Violations of what the scoring rule guarantees; every count should be 0."""
    rows = dose_determined(scores)
    dose = F.col("cardio_score_from_dose")
    totals = [F.greatest(rules.pressure_points(f"{m}D"), dose) for m in map_values]
    constant = F.greatest(*totals) == F.least(*totals)
    others = F.expr(" + ".join(OTHER_SUBSCORES))
    complete = F.expr(" AND ".join(f"{c} IS NOT NULL" for c in SUBSCORES))
    checks = [
        ("cardio_constant_in_map_given_dose", F.col("treated"), constant),
        ("treated_is_dose_determined", F.col("treated"), F.col("dose_determined")),
        ("total_minus_others_is_cardio", complete, (F.col("sofa_total") - others) == F.col("sofa_cardio")),
    ]
    aggs = []
    for name, applies, holds in checks:
        aggs += [F.count_if(applies).alias(name + "__n"), F.count_if(applies & ~holds).alias(name + "__bad")]
    listed = F.array(
        *[
            F.struct(
                F.lit(name).alias("invariant"),
                F.col(name + "__n").alias("n_checked"),
                F.col(name + "__bad").alias("n_violations"),
            )
            for name, _, _ in checks
        ]
    )
    return rows.agg(*aggs).select(F.inline(listed))


def overlap_monotone(sweep_rows: DataFrame, key: str = "stay_id") -> DataFrame:
    """Violations of "a longer window never holds less treatment time", same columns as
    ``score_invariants``. A group holds one row per swept width."""
    wider = Window.partitionBy(key, "bin").orderBy("width")
    drop = F.col("contaminated_hours") < F.lag("contaminated_hours").over(wider) - 1e-6
    checked = sweep_rows.select(drop.alias("drop")).filter(F.col("drop").isNotNull())
    return checked.agg(
        F.lit("overlap_monotone_in_window").alias("invariant"),
        F.count(F.lit(1)).alias("n_checked"),
        F.count_if("drop").alias("n_violations"),
    )


# --- release guard ----------------------------------------------------------------------


def aggregate_release(
    df: DataFrame,
    by: Sequence[str],
    entity: str,
    measures: Mapping[str, Column],
    min_entities: int = 24,
    forbidden: Sequence[str] = ("subject_id", "hadm_id", "stay_id"),
) -> DataFrame:
    """Group statistics fit for publication: no row-level identifier may be a column or
    be read by a measure, and groups of fewer than ``min_entities`` distinct entities are withheld.

    The distinct count is an ordinary second aggregate over (group, entity) partials.
    """
    named = set(by) | set(measures)
    leaked = sorted(named & (set(forbidden) | {entity}))
    if leaked:
        raise ValueError(f"row-level columns cannot be released: {leaked}")
    open_columns = df.drop(*forbidden, entity)
    for name, measure in measures.items():
        try:
            open_columns.groupBy(*by).agg(measure.alias(name)).schema
        except AnalysisException as error:
            raise ValueError(f"measure {name} reads a column that cannot be released") from error
    size = F.count_distinct(F.col(entity)).alias("n_entities")
    return (
        df.groupBy(*by)
        .agg(size, *[m.alias(name) for name, m in measures.items()])
        .filter(F.col("n_entities") >= min_entities)
    )


def withhold_small(
    cells: DataFrame, sizes: DataFrame, by: Sequence[str], within: Sequence[str], min_entities: int = 24
) -> DataFrame:
    """Cells of a released table, with all but ``by`` NULL where ``withheld``, which is added.

    ``sizes`` gives ``n_entities`` by cell. Cells of 1 to ``min_entities`` - 1 entities are withheld. Cells of one margin (``within``)
    add up to a total that is released too, so the smallest other cell that holds anybody is withheld along with them: what
    can be computed of the withheld ones is a sum over two cells or more and ``min_entities`` entities or more. One more is also the least
    that does. Empty cells stay, they hold nobody. Tables of cells are small, one row per cell.
    """
    sized = cells.join(sizes.select(*by, "n_entities"), list(by), "left")
    sized = sized.withColumn("__n", F.coalesce("n_entities", F.lit(0))).drop("n_entities")
    small = (F.col("__n") > 0) & (F.col("__n") < min_entities)
    margin = Window.partitionBy(*within)
    large_first = Window.partitionBy(*within, F.col("__n") >= min_entities).orderBy("__n", *by)
    marked = sized.withColumn("__any", F.max(small).over(margin)).withColumn("__place", F.row_number().over(large_first))
    hidden = small | (F.col("__any") & (F.col("__n") >= min_entities) & (F.col("__place") == 1))
    marked = marked.withColumn("withheld", hidden)
    rest = [F.when(~F.col("withheld"), F.col(c)).alias(c) for c in cells.columns if c not in by]
    return marked.select(*by, *rest, "withheld")


def decomposition_released(rows: DataFrame, min_entities: int = 24, key: str = "stay_id") -> Mapping[str, DataFrame]:
    """``summary``, ``by_severity`` and ``by_bin`` of the score decomposition as they may be published together."""
    band = F.lit(None).cast("int")
    for i, (lo, hi) in enumerate(SEVERITY_BANDS):
        band = F.when((F.col("sofa_total") > lo) & (F.col("sofa_total") <= hi), F.lit(i + 1)).otherwise(band)

    def sizes(df: DataFrame, *by: str) -> DataFrame:
        return df.groupBy(*by).agg(F.count_distinct(key).alias("n_entities"))

    whole = withhold_small(decomposition_summary(rows), sizes(rows, "window"), ["window"], ["window"], min_entities)
    banded = sizes(rows.withColumn("band_no", band).filter("band_no IS NOT NULL"), "window", "band_no")
    bands = withhold_small(by_severity(rows), banded, ["window", "band_no"], ["window"], min_entities)
    names = F.element_at(F.array(*[F.lit(f"({lo}, {hi}]") for lo, hi in SEVERITY_BANDS]), F.col("band_no"))
    bins = withhold_small(by_bin(rows), sizes(rows, "window", "bin"), ["window", "bin"], ["window"], min_entities)
    return {"summary": whole, "by_severity": bands.withColumn("band", names), "by_bin": bins}
