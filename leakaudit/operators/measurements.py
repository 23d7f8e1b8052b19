"""Raw coded events to hourly means per entity and feature."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leakaudit.functions.elapsed import hour_bucket, within_horizon


@dataclass(frozen=True)
class Item:
    """How one item code is read: its feature name, its validity rule and its scale."""

    itemid: int
    feature: str
    above: float | None = None
    low: float | None = None
    high: float | None = None
    divisor: float = 1.0
    needs_clear_warning: bool = False


def literal_table(spark: SparkSession, columns: Sequence[str], rows: Sequence[Sequence]) -> DataFrame:
    """A table written out in the program. ``VALUES`` plans as a local relation, so its
    size is known exactly when joins are planned."""

    def shown(v) -> str:
        if isinstance(v, bool) or v is None:
            return "NULL" if v is None else str(v).lower()
        if isinstance(v, str):
            return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return f"{v!r}D" if isinstance(v, float) else f"{v}L"

    values = ", ".join("(" + ", ".join(shown(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(columns)})")


_ITEM_COLUMNS = ["itemid", "feature", "above", "low", "high", "divisor", "needs_clear_warning"]


def item_dictionary(spark: SparkSession, items: Sequence[Item]) -> DataFrame:
    """The dictionary as a table; a literal of at most a few hundred rows."""
    rows = [
        (i.itemid, i.feature, i.above, i.low, i.high, i.divisor, i.needs_clear_warning) for i in items
    ]
    bounds = [f"CAST({c} AS DOUBLE) AS {c}" if c in ("above", "low", "high") else c for c in _ITEM_COLUMNS]
    return literal_table(spark, _ITEM_COLUMNS, rows).selectExpr(*bounds)


def label_items(events: DataFrame, items: Sequence[Item]) -> DataFrame:
    """Inner join to the dictionary: unlisted codes go away, listed ones get their rule.

    The ``isin`` repeats the join condition where the scan can use it. The hint is safe
    at any scale because the dictionary is a literal in the program.
    """
    codes = [i.itemid for i in items]
    dictionary = F.broadcast(item_dictionary(events.sparkSession, items))
    return events.filter(F.col("itemid").isin(codes)).join(dictionary, "itemid")


def valid_values(labelled: DataFrame) -> DataFrame:
    kept = labelled.filter(
        "valuenum IS NOT NULL AND (above IS NULL OR valuenum > above)"
        " AND (low IS NULL OR valuenum >= low) AND (high IS NULL OR valuenum <= high)"
    )
    if "warning" in labelled.columns:
        kept = kept.filter("NOT needs_clear_warning OR warning = 0")
    return kept


def to_origin(events: DataFrame, cohort: DataFrame, key: str, origin: str = "intime") -> DataFrame:
    """Attach each entity's origin. The cohort has one row per entity; it is broadcast
    when it measures small and shuffle-joined, with hot entities split, when not."""
    columns = [c for c in dict.fromkeys(["stay_id", key, origin])]
    return events.join(cohort.select(*columns), key)


def hourly_means(
    events: DataFrame,
    cohort: DataFrame,
    items: Sequence[Item],
    horizon: float,
    key: str = "stay_id",
) -> DataFrame:
    """(stay_id, feature, hours_from_admit, value): mean per whole hour since the origin.

    After this step an entity holds at most (horizon + 2) rows per feature however many
    events it had, which is what keeps everything downstream free of hot entities.
    """
    kept = to_origin(valid_values(label_items(events, items)), cohort, key)
    return (
        kept.filter(within_horizon("intime", "charttime", horizon))
        .groupBy("stay_id", "feature", hour_bucket("intime", "charttime").alias("hours_from_admit"))
        .agg(F.avg(F.col("valuenum") / F.col("divisor")).alias("value"))
    )


def relabel(long: DataFrame, sources: Sequence[str], target: str) -> DataFrame:
    """Many feature names to one, rows left as they are."""
    feature = F.when(F.col("feature").isin(list(sources)), F.lit(target)).otherwise(F.col("feature"))
    return long.withColumn("feature", feature)


def relabel_preferring(
    long: DataFrame, preference: Sequence[str], target: str, key: str = "stay_id"
) -> DataFrame:
    """Like ``relabel``, but where several sources share an hour only the first in
    ``preference`` stays. A group holds at most one row per source name."""
    order = F.lit(len(preference))
    for rank, name in enumerate(preference):
        order = F.when(F.col("feature") == name, F.lit(rank)).otherwise(order)
    listed = long.filter(F.col("feature").isin(list(preference)))
    rest = long.filter(~F.col("feature").isin(list(preference)))
    first = Window.partitionBy(key, "hours_from_admit").orderBy("source_rank")
    chosen = (
        listed.withColumn("source_rank", order)
        .withColumn("place", F.row_number().over(first))
        .filter(F.col("place") == 1)
        .drop("place", "source_rank")
    )
    return rest.unionByName(chosen.withColumn("feature", F.lit(target)))


def nearest_ratio(
    long: DataFrame, numerator: str, denominator: str, key: str = "stay_id", max_gap: float | None = None
) -> DataFrame:
    """Each numerator reading over the denominator reading nearest in time, the earlier
    one on a tie. Input is hourly, so an entity's window holds a few dozen rows."""
    pair = long.filter(F.col("feature").isin(numerator, denominator))
    reading = F.when(F.col("feature") == denominator, F.struct("hours_from_admit", "value"))
    # On equal hours the denominator sorts first, so "before" includes the same hour.
    order = [F.col("hours_from_admit"), (F.col("feature") == numerator).cast("int")]
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # The readings to come, as those before in descending order: a frame that only grows.
    after = Window.partitionBy(key).orderBy(*[o.desc() for o in order]).rowsBetween(Window.unboundedPreceding, -1)
    seen = (
        pair.withColumn("reading", reading)
        .withColumn("prev", F.last("reading", ignorenulls=True).over(before))
        .withColumn("next", F.last("reading", ignorenulls=True).over(after))
        .filter(F.col("feature") == numerator)
    )
    back = F.col("hours_from_admit") - F.col("prev.hours_from_admit")
    ahead = F.col("next.hours_from_admit") - F.col("hours_from_admit")
    take_next = F.col("prev").isNull() | (ahead < back)
    matched = seen.withColumn("match", F.when(take_next, F.col("next")).otherwise(F.col("prev")))
    gap = F.abs(F.col("match.hours_from_admit") - F.col("hours_from_admit"))
    out = matched.filter(F.col("match").isNotNull()).select(
        key,
        "hours_from_admit",
        F.col("value").alias("numerator"),
        F.col("match.value").alias("denominator"),
        gap.alias("gap_hours"),
        (F.col("value") / F.col("match.value")).alias("ratio"),
    )
    return out if max_gap is None else out.filter(F.col("gap_hours") <= max_gap)
