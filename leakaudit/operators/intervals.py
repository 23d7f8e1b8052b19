"""Treatment intervals: extraction, unit guard, union, window contamination, doses, actions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakaudit.functions import rules
from leakaudit.functions.elapsed import elapsed_hours
from leakaudit.operators.grid import Grid, covered_windows, touching_bins
from leakaudit.operators.measurements import literal_table, to_origin

DOSE_SCORED = ("dopamine", "dobutamine", "epi", "norepi")
DOSE_UNIT = "mcg/kg/min"


def infusion_intervals(
    infusions: DataFrame, cohort: DataFrame, drugs: Mapping[int, str], key: str = "stay_id"
) -> DataFrame:
    """One row per infusion of a listed item, in hours since the entity's origin.

    There is no horizon filter: time before the origin and after the horizon counts.
    """
    names = literal_table(infusions.sparkSession, ["itemid", "drug"], list(drugs.items()))
    listed = infusions.filter(
        F.col("itemid").isin(list(drugs)) & (F.col("amount") > 0) & F.col("endtime").isNotNull()
    )
    return to_origin(listed.join(F.broadcast(names), "itemid", "left"), cohort, key).select(
        "stay_id",
        "itemid",
        "drug",
        elapsed_hours("intime", "starttime").alias("start_h"),
        elapsed_hours("intime", "endtime").alias("end_h"),
        "rate",
        "rateuom",
        "amount",
    )


def _wrong_unit(drugs: Sequence[str], unit: str) -> Column:
    """True, never NULL: a missing unit counts as a wrong one."""
    return F.coalesce(F.col("drug").isin(list(drugs)), F.lit(False)) & ~F.col("rateuom").eqNullSafe(F.lit(unit))


def unit_guard(intervals: DataFrame, drugs: Sequence[str] = DOSE_SCORED, unit: str = DOSE_UNIT) -> DataFrame:
    """Drop, rather than convert, dose-scored rows in another unit."""
    return intervals.filter(~_wrong_unit(drugs, unit))


def unit_guard_audit(
    intervals: DataFrame, drugs: Sequence[str] = DOSE_SCORED, unit: str = DOSE_UNIT
) -> DataFrame:
    return (
        intervals.filter(_wrong_unit(drugs, unit))
        .groupBy("drug", "rateuom")
        .agg(F.count(F.lit(1)).alias("n_dropped"))
    )


def drug_counts(intervals: DataFrame) -> DataFrame:
    return intervals.groupBy("drug").agg(F.count(F.lit(1)).alias("n"))


# --- union --------------------------------------------------------------------------
#
# Intervals of one entity that start in the same minute collapse first, map side, so an
# entity brings at most one row per minute of its timeline to the ordered step, however
# many intervals or copies of them there are. The step streams over its sorted rows.


def _by_start(intervals: DataFrame, key: str) -> DataFrame:
    """Distinct (entity, start): the furthest end, how many rows had a length, and how
    far the earlier starts of the entity reach."""
    earlier = Window.partitionBy(key).orderBy("start_h").rowsBetween(Window.unboundedPreceding, -1)
    return (
        intervals.groupBy(key, "start_h")
        .agg(F.max("end_h").alias("end_h"), F.count_if(F.col("end_h") > F.col("start_h")).alias("n_long"))
        .withColumn("reach", F.max("end_h").over(earlier))
    )


def interval_union(intervals: DataFrame, key: str = "stay_id", mark_first: bool = False) -> DataFrame:
    """(key, start_h, end_h): overlapping or touching intervals merged. ``mark_first`` adds
    ``is_first``, true for an entity's earliest, from which a dense grid can start."""
    opens = F.col("reach").isNull() | (F.col("start_h") > F.col("reach"))
    so_far = Window.partitionBy(key).orderBy("start_h").rowsBetween(Window.unboundedPreceding, 0)
    head = F.last(F.when(opens, F.col("start_h")), ignorenulls=True).over(so_far)
    islands = _by_start(intervals, key).withColumn("head", head).groupBy(key, "head")
    ends = islands.agg(F.max("end_h").alias("end_h"), F.max(F.col("reach").isNull()).alias("is_first"))
    return ends.select(key, F.col("head").alias("start_h"), "end_h", *(["is_first"] if mark_first else []))


def overlapping_entities(intervals: DataFrame, key: str = "stay_id") -> DataFrame:
    """(key, overlapping): whether any two intervals of the entity share time."""
    shared = (F.col("n_long") > 1) | F.coalesce(F.col("start_h") < F.col("reach"), F.lit(False))
    return _by_start(intervals, key).groupBy(key).agg(F.max(shared).alias("overlapping"))


def overlapping_share(intervals: DataFrame, key: str = "stay_id") -> DataFrame:
    return overlapping_entities(intervals, key).agg(
        F.count(F.lit(1)).alias("n_entities"),
        F.count_if("overlapping").alias("n_overlapping"),
        F.avg(F.col("overlapping").cast("double")).alias("share_overlapping"),
    )


# --- coverage of decision windows ---------------------------------------------------


def _measured(hours: Column) -> Column:
    """Sums of pieces differ from the whole in the last bits; nine decimals settle both."""
    return F.round(hours, 9)


def _skeleton(entities: DataFrame, grid: Grid, *columns: Column) -> DataFrame:
    """Every bin of every entity with neutral values, to be unioned in front of an
    aggregate: the dense result then needs no join and no second exchange."""
    return entities.select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(grid.n_bins - 1))).alias("bin")
    ).select("*", *columns)


def _covered(intervals: DataFrame, grid: Grid, width, key: str, by: Sequence[str] = ()) -> DataFrame:
    w = width if isinstance(width, Column) else F.lit(float(width))
    decision = (F.col("bin") + 1) * F.lit(float(grid.interval))
    piece = rules.overlap("start_h", "end_h", decision - w, decision)
    if "is_first" in intervals.columns:
        # The entity's first island visits every bin, so the grid is dense without a second read.
        placed = covered_windows(intervals, "start_h", "end_h", w, grid, F.col("is_first"))
        pieces = placed.select(key, *by, "bin", piece.alias("hours"))
        return pieces.groupBy(key, *by, "bin").agg(_measured(F.sum("hours")).alias("contaminated_hours"))
    pieces = covered_windows(intervals, "start_h", "end_h", w, grid)
    pieces = pieces.select(key, *by, "bin", piece.alias("hours"))
    entities = intervals.select(key, *by).distinct()
    dense = pieces.unionByName(_skeleton(entities, grid, F.lit(0.0).alias("hours")))
    return dense.groupBy(key, *by, "bin").agg(_measured(F.sum("hours")).alias("contaminated_hours"))


def _with_share(covered: DataFrame, grid: Grid, width, denominator: str = "window") -> DataFrame:
    t = (F.col("bin") + 1) * F.lit(float(grid.interval))
    w = width if isinstance(width, Column) else F.lit(float(width))
    span = w if denominator == "window" else F.least(w, t)
    return covered.withColumn("t", t).withColumn(
        "pct_of_window", F.least(F.lit(1.0), F.col("contaminated_hours") / span)
    )


def window_contamination(
    intervals: DataFrame,
    grid: Grid,
    width: float,
    key: str = "stay_id",
    merged: bool = False,
    denominator: str = "window",
) -> DataFrame:
    """(key, bin, contaminated_hours, t, pct_of_window) for every entity with intervals.

    ``denominator="observed"`` divides by the part of the window after the origin.
    Pass ``merged=True`` when the input already is an ``interval_union``.
    """
    islands = intervals if merged else interval_union(intervals, key, mark_first=True)
    return _with_share(_covered(islands, grid, width, key), grid, width, denominator)


def window_contamination_summed(
    intervals: DataFrame, grid: Grid, width: float, key: str = "stay_id"
) -> DataFrame:
    """The comparison form: overlaps added up without a union, so concurrent intervals
    count twice."""
    return _with_share(_covered(intervals, grid, width, key), grid, width)


def window_sweep_rows(
    intervals: DataFrame, grid: Grid, widths: Sequence[float], key: str = "stay_id", merged: bool = False
) -> DataFrame:
    """``window_contamination`` for several widths from one union and one aggregate."""
    islands = intervals if merged else interval_union(intervals, key, mark_first=True)
    each = islands.withColumn("width", F.explode(F.array(*[F.lit(float(w)) for w in widths])))
    w = F.col("width")
    return _with_share(_covered(each, grid, w, key, ["width"]), grid, w)


# --- doses and actions --------------------------------------------------------------


def dose_matrix(
    intervals: DataFrame, grid: Grid, drugs: Sequence[str] = DOSE_SCORED, key: str = "stay_id"
) -> DataFrame:
    """Highest concurrent rate per drug and bin, for entities with any listed drug.

    0 where no interval of the drug is active; NULL where one is but none has a rate.
    """
    listed = intervals.filter(F.col("drug").isin(list(drugs))).select(key, "drug", "start_h", "end_h", "rate")
    active = touching_bins(listed, "start_h", "end_h", grid).select(key, "bin", "drug", "rate")
    entities = listed.select(key).distinct()
    neutral = [F.lit(None).cast("string").alias("drug"), F.lit(None).cast("double").alias("rate")]
    rows = active.unionByName(_skeleton(entities, grid, *neutral))

    def peak(drug: str) -> Column:
        own = f"FILTER (WHERE drug = '{drug}')"
        return F.expr(f"CASE WHEN count(1) {own} > 0 THEN max(rate) {own} ELSE 0.0D END AS {drug}")

    return rows.groupBy(key, "bin").agg(*[peak(d) for d in drugs])


def action_bins(entities: DataFrame, intervals: DataFrame, grid: Grid, key: str = "stay_id") -> DataFrame:
    """(key, bin, action): 1 where any interval touches the bin, for every entity given,
    treated or not. Intervals of other entities are left out."""
    active = touching_bins(intervals.select(key, "start_h", "end_h"), "start_h", "end_h", grid).select(
        key, "bin", F.lit(1).alias("action"), F.lit(False).alias("listed")
    )
    dense = _skeleton(entities.select(key), grid, F.lit(0).alias("action"), F.lit(True).alias("listed"))
    grouped = active.unionByName(dense).groupBy(key, "bin")
    return (
        grouped.agg(F.max("action").alias("action"), F.max("listed").alias("listed"))
        .filter("listed")
        .drop("listed")
    )


def next_action(actions: DataFrame, lead: int = 1, key: str = "stay_id") -> DataFrame:
    """Label of bin t = action of bin t + lead. The action grid is dense, so the lead is
    a shift of the bin number: no window, no shuffle. The last bins have no label."""
    return actions.select(
        key, (F.col("bin") - F.lit(lead)).alias("bin"), F.col("action").alias("action_next")
    ).filter(F.col("bin") >= 0)
