"""Exact classification metrics as grouped, optionally weighted aggregations.

Predictions are rows of (by..., y, score[, weight]); ``by`` names the cells - variant,
probe, replicate - that are scored side by side. All cells of a metric come out of the
same aggregation, so a bootstrap is one query rather than a loop.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leakaudit.functions.codes import with_digits
from leakaudit.operators.quantiles import exact_quantiles
from leakaudit.operators.resample import SEED, bootstrap_vectors, drawn_matrix

_EDGES = 32


def _counts(df: DataFrame, by: Sequence[str], *extra: Column | str) -> DataFrame:
    """Weighted positives and negatives per cell and ``extra`` key."""
    w = F.col("weight") if "weight" in df.columns else F.lit(1)
    return df.groupBy(*by, *extra).agg(
        F.sum(F.when(F.col("y") == 1, w).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col("y") == 1, 0).otherwise(w)).alias("neg"),
    )


def with_score_bucket(df: DataFrame, edges_from: DataFrame | None = None) -> DataFrame:
    """Add ``bucket``, a monotone function of the score with roughly even content.

    1024 approximate percentiles; the bucket is how many lie below the score, found by halving: eleven comparisons a row. The metric
    is exact for any monotone bucket, so the sketch only decides how even the work is.
    """
    n = _EDGES * _EDGES
    probs = ", ".join(f"{i / n!r}D" for i in range(n))
    sketch = (df if edges_from is None else edges_from).agg(
        F.expr(f"percentile_approx(score, array({probs}), {4 * n}) AS fine")
    )
    found = df.withColumns({"__e": sketch.scalar(), "__b": F.lit(0)})
    for step in [n >> i for i in range(1, n.bit_length())] + [1]:  # each a projection of its own, or their terms would double
        found = found.withColumn("__b", F.expr(f"__b + IF(get(__e, __b + {step - 1}) < score, {step}, 0)"))
    return found.selectExpr(*df.columns, "__b AS bucket")


def auroc(df: DataFrame, by: Sequence[str] = (), buckets: bool = True) -> DataFrame:
    """Area under the ROC curve with ties counted half, NULL for a one-class cell.

    Equal to the rank-sum statistic: every positive beats the negatives scored below it. Rows collapse to distinct
    scores first. The running count of negatives then works inside ranges that share the leading digits of the score's
    code, and the ranges' sums are added up in two more steps, each of one row per range: no task orders more than
    2^22 rows of a cell, however scores crowd, and no edges are looked for beforehand. ``buckets=False`` makes one range.
    """
    by = list(by)
    scored = _counts(df.withColumn("score", F.col("score").cast("double")), by, "score")
    per_score = with_digits(scored, "score", "__d1", "__d2") if buckets else scored.withColumns({"__d1": F.lit(0), "__d2": F.lit(0)})
    below = Window.partitionBy(*by, "__d1", "__d2").orderBy("score")
    wins = F.col("pos") * (F.sum("neg").over(below) - F.col("neg") * 0.5)
    sums = [F.sum(c).alias(c) for c in ("wins", "pos", "neg")]
    ranges = per_score.withColumn("wins", wins).groupBy(*by, "__d1", "__d2").agg(*sums)
    for within, order in (([*by, "__d1"], "__d2"), (by, "__d1")):
        earlier = Window.partitionBy(*(within or [F.lit(0)])).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        carried = F.col("wins") + F.col("pos") * F.coalesce(F.sum("neg").over(earlier), F.lit(0))
        ranges = ranges.withColumn("wins", carried).groupBy(*within).agg(*sums)
    return ranges.select(*by, F.try_divide("wins", F.col("pos").cast("double") * F.col("neg")).alias("auroc"))


def _confusion(df: DataFrame, by: Sequence[str], threshold: float) -> DataFrame:
    w = F.col("weight") if "weight" in df.columns else F.lit(1)
    said, true = F.col("score") > threshold, F.col("y") == 1

    def total(test: Column, name: str) -> Column:
        return F.sum(F.when(test, w).otherwise(0)).cast("double").alias(name)

    return df.groupBy(*by).agg(
        total(said & true, "tp"), total(said & ~true, "fp"), total(~said & true, "fn"), total(~said & ~true, "tn")
    )


def macro_f1(df: DataFrame, by: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    """Mean of the two classes' F1 at ``score > threshold``; a class neither present nor
    predicted counts 0."""

    def f1(hit: str) -> Column:
        errors = F.col("fp") + F.col("fn")
        return F.coalesce(F.try_divide(2 * F.col(hit), 2 * F.col(hit) + errors), F.lit(0.0))

    return _confusion(df, by, threshold).select(*by, ((f1("tp") + f1("tn")) / 2).alias("macro_f1"))


def balanced_accuracy(df: DataFrame, by: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    """Mean recall over the classes present."""
    pos = F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    neg = F.try_divide(F.col("tn"), F.col("tn") + F.col("fp"))
    both = F.coalesce((pos + neg) / 2, pos, neg)
    return _confusion(df, by, threshold).select(*by, both.alias("balanced_acc"))


def equal_edges(n: int) -> list[float]:
    step = 1.0 / n
    return [i * step for i in range(n)] + [1.0]


def calibration_error(df: DataFrame, by: Sequence[str] = (), n_bins: int = 10) -> DataFrame:
    """Expected calibration error over equal score bins [lo, hi). A score of exactly 1
    lies in no bin yet counts in the denominator."""
    w = F.col("weight") if "weight" in df.columns else F.lit(1)
    per_bin = df.groupBy(*by, equal_bin("score", n_bins).alias("bin_no")).agg(
        F.sum(w).alias("n"), F.sum(w * F.col("y")).alias("hits"), F.sum(w * F.col("score")).alias("claimed")
    )
    return calibration_of_bins(per_bin, by)


def equal_bin(score: str, n_bins: int = 10) -> Column:
    """Which of the equal bins [lo, hi) holds the score; NULL for none."""
    edges = equal_edges(n_bins)
    bin_no = F.lit(None).cast("int")
    for i in range(n_bins):
        bin_no = F.when((F.col(score) >= edges[i]) & (F.col(score) < edges[i + 1]), F.lit(i)).otherwise(bin_no)
    return bin_no


def calibration_of_bins(per_bin: DataFrame, by: Sequence[str], *more: Column) -> DataFrame:
    """The error from (by..., bin_no, n, hits, claimed), beside further aggregates."""
    gap = F.when(F.col("bin_no").isNotNull(), F.abs(F.col("hits") - F.col("claimed"))).otherwise(0.0)
    return per_bin.groupBy(*by).agg((F.sum(gap) / F.sum("n")).alias("ece"), *more)


# --- mutual information ---------------------------------------------------------------


def quantile_edges(long: DataFrame, n_bins: int = 10) -> DataFrame:
    """(feature, inner): inner bin edges per feature, equal edges collapsed."""
    probs = [i / n_bins for i in range(n_bins + 1)]
    distinct = F.array_sort(F.array_distinct(F.collect_list("quantile")))
    per = exact_quantiles(long, ["feature"], "value", probs).groupBy("feature").agg(distinct.alias("edges"))
    inner = F.slice("edges", F.lit(2), F.greatest(F.size("edges") - 2, F.lit(0)))
    return per.select("feature", inner.alias("inner"))


def discretize(long: DataFrame, edges: DataFrame, digits: int = 9, most: int | None = None) -> DataFrame:
    """Replace ``value`` by its bin: the number of inner edges of its feature it reaches,
    0 for a NULL and for a feature that never had a value.

    Features are columns of one table and an edge list is at most ``n_bins`` long, so
    all lists fit in one scalar; a join would shuffle the tall table by its few features. ``most`` says
    how many edges a list can hold: so many comparisons in compiled code are faster than a filter of the list.
    """
    lists = edges.agg(F.map_from_entries(F.collect_list(F.struct("feature", "inner")))).scalar()
    # Named twice, the rounded value stays a column: inside the filter it would be formed for each edge.
    reached = "IF(__rounded IS NULL, 0, coalesce(size(filter(__list, e -> e <= __rounded)), 0))"
    if most is not None:
        reached = " + ".join(["0", *[f"IF(get(__list, {i}) <= __rounded, 1, 0)" for i in range(most)]])
    kept = [c for c in long.columns if c != "value"]
    looked = long.withColumn("__lists", lists).withColumns({"__list": F.expr("__lists[feature]"), "__rounded": F.round("value", digits)})
    return looked.selectExpr(*kept, f"{reached} AS value_bin")


def mutual_information_by_feature(binned: DataFrame, by: Sequence[str] = ("feature",)) -> DataFrame:
    """(by..., mi) in nats between ``value_bin`` and ``y``.

    The table of bins by class has a few dozen cells per feature, so its margins are
    windows over that many rows.
    """
    w = F.sum("weight") if "weight" in binned.columns else F.count(F.lit(1))
    cells = binned.groupBy(*by, "value_bin", "y").agg(w.cast("double").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by))
    row = F.sum("n").over(Window.partitionBy(*by, "value_bin"))
    column = F.sum("n").over(Window.partitionBy(*by, "y"))
    part = F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("r") * F.col("c")))
    shares = cells.withColumn("t", total).withColumn("r", row).withColumn("c", column)
    return shares.groupBy(*by).agg(F.sum(part).alias("mi"))


def mutual_information(long: DataFrame, n_bins: int = 10) -> DataFrame:
    """(feature, mi) for rows of (feature, value, y)."""
    return mutual_information_by_feature(discretize(long, quantile_edges(long, n_bins), most=n_bins - 1))


# --- cluster bootstrap ----------------------------------------------------------------

METRICS: dict[str, Callable[..., DataFrame]] = {
    "auroc": auroc,
    "macro_f1": macro_f1,
    "balanced_acc": balanced_accuracy,
    "ece": calibration_error,
}


_GROUPS_AT_ONCE = 1024  # groups whose vectors a task holds unpacked
_ROWS_SWEPT = 256  # rows compared with each other, whose vectors stay in a core's cache


def _drawn_totals(rows: DataFrame, vectors: DataFrame, keys: Sequence[str], on: Sequence[str], totals: Mapping[str, str], n: int) -> DataFrame:
    """(keys..., rep, totals...): per replicate the sums of columns of ``rows`` times how often their group is drawn;
    the first is a count of at least 1.

    A group meets its vector once, with a list of its keys and columns: at most one entry per key. A task adds (keys x groups) times
    (groups x replicates) into one vector per key, so neither rows nor keys are ever multiplied by replicates before the sums are.
    """
    names, on = list(totals), list(on)
    inner = [k for k in keys if k not in on]
    entry = F.struct(*inner, *[F.col(totals[c]).cast("double").alias(f"__{c}") for c in names])
    listed = rows.groupBy(*on).agg(F.collect_list(entry).alias("entries")).join(vectors.hint("merge"), on)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, np.ndarray] = {}
        kinds = None
        for batch in batches:
            for at in range(0, batch.num_rows, _GROUPS_AT_ONCE):
                part = batch.slice(at, _GROUPS_AT_ONCE)
                drawn = drawn_matrix(part.column("drawn"), n).astype(np.float64)
                entries = part.column("entries")
                flat, of = entries.flatten(), np.repeat(np.arange(part.num_rows), np.diff(entries.offsets.to_numpy()))
                cells = [flat.field(k) if k in inner else part.column(k).take(pa.array(of)) for k in keys]
                kinds = [c.type for c in cells]
                code = np.zeros(len(of), np.int64)
                for c in cells:
                    coded = c.dictionary_encode()
                    _, code = np.unique(code * (len(coded.dictionary) + 1) + coded.indices.fill_null(len(coded.dictionary)).to_numpy(), return_inverse=True)
                own, first = np.unique(code, return_index=True)
                named = list(zip(*[c.take(pa.array(first)).to_pylist() for c in cells]))
                for j, c in enumerate(names):
                    weights = np.bincount(code * part.num_rows + of, flat.field(f"__{c}").to_numpy(zero_copy_only=False), len(own) * part.num_rows)
                    for key, total in zip(named, weights.reshape(len(own), -1) @ drawn):
                        found.setdefault(key, np.zeros((len(names), n)))[j] += total
        if found:
            told = [pa.array([key[i] for key in found], kind) for i, kind in enumerate(kinds)]
            sums = [pa.array([total[j] for total in found.values()], pa.list_(pa.float64())) for j in range(len(names))]
            yield pa.RecordBatch.from_arrays([*told, *sums], names=[*keys, *names])

    fields = {f.name: f.dataType for f in rows.schema.fields}
    schema = T.StructType([*[T.StructField(k, fields[k]) for k in keys], *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in names]])
    sums = [vector_to_array(Summarizer.sum(array_to_vector(F.col(c)))).alias(c) for c in names]
    added = listed.mapInArrow(add, schema).groupBy(*keys).agg(*sums)
    each = F.transform(names[0], lambda v, i: F.struct(i.alias("rep"), *[F.get(c, i).alias(c) for c in names]))
    return added.select(*keys, F.inline(each))


def _auroc_vectors(rows: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """(by..., rep, value) of rows (by..., bucket, score, y, copies, drawn): the area under the curve of all replicates in one sweep.

    Rows are swept in score order within their bucket, some at a time: positives meet the negatives among them by a product, and what
    came before as a vector over the replicates; the buckets' sums, one row each, are swept again per cell. Memory is a few vectors, whatever a bucket holds.
    """
    by = list(by)
    kept = rows.select(*by, "bucket", "score", F.col("y").cast("int").alias("y"), F.col("copies").cast("long").alias("copies"), "drawn")

    def lists(found: list[np.ndarray]) -> pa.Array:
        flat = np.concatenate(found) if found else np.zeros(0)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * n), pa.array(flat))

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, score, open_, sums, done = None, None, None, None, []

        def told() -> pa.RecordBatch:
            cells = [pa.array([d[0][j] for d in done], kinds[j]) for j in range(len(by) + 1)]
            out = pa.RecordBatch.from_arrays([*cells, *[lists([d[1][j] for d in done]) for j in range(3)]], names=[*by, "bucket", "wins", "pos", "neg"])
            done.clear()
            return out

        slices = (batch.slice(at, _ROWS_SWEPT) for batch in batches for at in range(0, batch.num_rows, _ROWS_SWEPT))
        for batch in slices:
            cells = [batch.column(c) for c in [*by, "bucket"]]
            kinds = [c.type for c in cells]
            codes = [c.dictionary_encode().indices.fill_null(-1).to_numpy() for c in cells]
            scores, empty = batch.column("score"), batch.column("score").is_null().to_numpy(zero_copy_only=False)
            values = scores.to_numpy(zero_copy_only=False)
            rank = np.concatenate([[0], np.cumsum((values[1:] != values[:-1]) & ~(empty[1:] & empty[:-1]))])
            positive, copies = batch.column("y").to_numpy(zero_copy_only=False) == 1, batch.column("copies").to_numpy()
            flat = drawn_matrix(batch.column("drawn"), n).astype(np.float64)
            if (copies != 1).any():
                flat *= copies[:, None]
            runs = [0, *np.flatnonzero(np.any([c[1:] != c[:-1] for c in codes], axis=0)) + 1, batch.num_rows]
            for a, b in zip(runs[:-1], runs[1:]):  # the rows of one bucket
                own = tuple(c[int(a)].as_py() for c in cells)
                if own != key:
                    if key is not None:
                        done.append((key, sums))
                    key, sums, open_, score = own, np.zeros((3, n)), np.zeros((2, n)), None
                    first = None
                else:
                    first = rank[a] if scores[int(a)].as_py() == score else None
                up, down = np.flatnonzero(positive[a:b]) + a, np.flatnonzero(~positive[a:b]) + a
                pos, neg, high, low = flat[up], flat[down], rank[up][:, None], rank[down][None, :]
                below = (low < high) + 0.5 * (low == high)
                sums[0] += np.einsum("ij,ij->j", pos, below @ neg) + pos.sum(0) * sums[2]
                if first is not None:  # rows of the score that was open beat half of each other
                    sums[0] += (open_[0] * neg[rank[down] == first].sum(0) - open_[1] * pos[rank[up] == first].sum(0)) / 2
                sums[1] += pos.sum(0)
                sums[2] += neg.sum(0)
                last = np.stack([pos[rank[up] == rank[b - 1]].sum(0), neg[rank[down] == rank[b - 1]].sum(0)])
                open_, score = last + open_ if first == rank[b - 1] else last, scores[int(b) - 1].as_py()
            yield told()
        if key is not None:
            done.append((key, sums))
            yield told()

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, wins, pos, neg, done = None, None, None, None, []

        def told() -> pa.RecordBatch:
            cells = [pa.array([d[0][j] for d in done], kinds[j]) for j in range(len(by))]
            out = pa.RecordBatch.from_arrays([*cells, pa.array([d[1] for d in done], pa.list_(pa.float64()))], names=[*by, "values"])
            done.clear()
            return out

        def close() -> None:
            both = pos * neg
            done.append((key, [float(w / b) if b > 0 else None for w, b in zip(wins, both)]))

        for batch in batches:
            kinds = [batch.schema.field(c).type for c in by]
            keys = list(zip(*[batch.column(c).to_pylist() for c in by])) if by else [()] * batch.num_rows
            three = [batch.column(c).flatten().to_numpy().reshape(-1, n) for c in ("wins", "pos", "neg")]
            for i, own in enumerate(keys):
                if own != key:
                    if key is not None:
                        close()
                    key, wins, pos, neg = own, np.zeros(n), np.zeros(n), np.zeros(n)
                wins = wins + three[0][i] + three[1][i] * neg
                pos, neg = pos + three[1][i], neg + three[2][i]
            yield told()
        if key is not None:
            close()
            yield told()

    fields = {f.name: f.dataType for f in kept.schema.fields}
    numbers = T.ArrayType(T.DoubleType())
    cells = [T.StructField(c, fields[c]) for c in by]
    # a fixed number: the sweep's work is a vector per row, which merging partitions by size doesn't see
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = kept.repartition(tasks, *by, "bucket").sortWithinPartitions(*by, "bucket", "score")
    parts = sorted_rows.mapInArrow(within, T.StructType([*cells, T.StructField("bucket", fields["bucket"]), *[T.StructField(c, numbers) for c in ("wins", "pos", "neg")]]))
    placed = parts.repartition(*by) if by else parts.repartition(1)
    values = placed.sortWithinPartitions(*by, "bucket").mapInArrow(across, T.StructType([*cells, T.StructField("values", numbers)]))
    return values.select(*by, F.posexplode("values").alias("rep", "value")).filter("value IS NOT NULL")


_SWEPT = 4  # score buckets swept as one


def bootstrap_replicates(
    predictions: DataFrame,
    metric: str = "auroc",
    by: Sequence[str] = (),
    n_boot: int = 300,
    group: str = "stay_id",
    seed: int = SEED,
    paired: bool = False,
) -> DataFrame:
    """(by..., rep, value): the metric on whole groups drawn with replacement.

    A group drawn twice counts twice. Replicates holding one class only are left out.
    Each cell draws from its own groups; ``paired`` draws once from all groups, for
    differences between cells. A group's draws travel as one vector over the replicates.
    """
    by = list(by)
    drawn_by = [] if paired else by
    vectors = bootstrap_vectors(predictions.select(*drawn_by, group).distinct(), n_boot, group, seed, drawn_by)
    on, cell = [*drawn_by, group], [*by, "rep"]
    if metric == "auroc":
        rows = with_score_bucket(predictions).withColumn("bucket", F.floor(F.col("bucket") / _SWEPT).cast("int"))
        merged = rows.groupBy(*by, group, "y", "score", "bucket").agg(F.count(F.lit(1)).alias("copies"))
        return _auroc_vectors(merged.join(vectors.hint("merge"), on), by, n_boot)
    if metric == "ece":
        binned = predictions.groupBy(*by, group, equal_bin("score").alias("bin_no")).agg(
            F.count(F.lit(1)).alias("n"), F.sum("y").alias("hits"), F.sum("score").alias("claimed")
        )
        per_bin = _drawn_totals(binned, vectors, [*by, "bin_no"], on, {"n": "n", "hits": "hits", "claimed": "claimed"}, n_boot).filter("n > 0")
        both = (F.sum("hits") > 0) & (F.sum(F.col("n") - F.col("hits")) > 0)
        return calibration_of_bins(per_bin, cell, both.alias("both")).filter("both").select(*cell, F.col("ece").alias("value"))
    # What was said and what was true is all that the thresholded metrics see.
    said = predictions.groupBy(*by, group, "y", (F.col("score") > 0.5).cast("double").alias("score")).agg(F.count(F.lit(1)).alias("copies"))
    drawn = _drawn_totals(said, vectors, [*by, "y", "score"], on, {"weight": "copies"}, n_boot).filter("weight > 0")
    two_classes = drawn.groupBy(*cell).agg((F.min("y") != F.max("y")).alias("both")).filter("both").drop("both")
    return METRICS[metric](drawn, cell).join(two_classes, cell, "left_semi").withColumnRenamed(metric, "value")


def percentile_interval(
    replicates: DataFrame, by: Sequence[str] = (), level: float = 0.95, digits: int = 9
) -> DataFrame:
    """(by..., ci_lo, ci_hi, n_reps). A cell holds one value per replicate."""
    tail = (1.0 - level) / 2.0
    bounds = F.percentile("value", F.array(F.lit(tail), F.lit(1.0 - tail)))
    per = replicates.groupBy(*by).agg(bounds.alias("b"), F.count("value").alias("n_reps"))
    return per.select(
        *by, F.round(F.col("b")[0], digits).alias("ci_lo"), F.round(F.col("b")[1], digits).alias("ci_hi"), "n_reps"
    )


def cluster_bootstrap(predictions: DataFrame, metric: str = "auroc", by: Sequence[str] = (), **options) -> DataFrame:
    """Point estimate and percentile interval of a metric per cell."""
    level = options.pop("level", 0.95)
    reps = bootstrap_replicates(predictions, metric, by, **options)
    point = METRICS[metric](predictions, by)
    interval = percentile_interval(reps, by, level)
    if by:
        return point.join(interval, list(by))
    row = interval.select(F.struct(*interval.columns)).scalar()
    return point.withColumn("__i", row).select(metric, "__i.*")


def mutual_information_replicates(
    long: DataFrame,
    n_boot: int = 300,
    n_bins: int = 10,
    group: str = "stay_id",
    seed: int = SEED,
) -> DataFrame:
    """(feature, rep, value) for rows of (group, feature, value, y). Bins stay those of
    the full data; each group's table of bins by class is what gets drawn."""
    return replicates_of_counts(binned_counts(long, n_bins, group), bootstrap_vectors(long.select(group).distinct(), n_boot, group, seed), n_boot, group)


def binned_counts(long: DataFrame, n_bins: int = 10, group: str = "stay_id") -> DataFrame:
    """(group, feature, value_bin, y, copies): all that mutual information and its replicates see of rows of (group, feature, value, y)."""
    binned = discretize(long, quantile_edges(long, n_bins), most=n_bins - 1)
    return binned.groupBy(group, "feature", "value_bin", "y").agg(F.count(F.lit(1)).alias("copies"))


def replicates_of_counts(merged: DataFrame, vectors: DataFrame, n_boot: int, group: str = "stay_id") -> DataFrame:
    """(feature, rep, value) of ``binned_counts``, given the groups' draws."""
    drawn = _drawn_totals(merged, vectors, ["feature", "value_bin", "y"], [group], {"weight": "copies"}, n_boot).filter("weight > 0")
    return mutual_information_by_feature(drawn, ["feature", "rep"]).withColumnRenamed("mi", "value")


def paired_delta(
    predictions: DataFrame,
    cell: str,
    base,
    other,
    n_boot: int = 300,
    group: str = "stay_id",
    seed: int = SEED,
    threshold: float = 0.10,
) -> DataFrame:
    """AUROC of cell ``base`` minus cell ``other`` on the same drawn groups, its interval,
    and the pre-registered verdict: A when the interval leaves out 0 and the difference
    reaches ``threshold``, else B."""
    two = predictions.filter(F.col(cell).isin(base, other))

    def difference(value: str) -> Column:
        pick = [F.max(F.when(F.col(cell) == c, F.col(value))) for c in (base, other)]
        return pick[0] - pick[1]

    reps = (
        bootstrap_replicates(two, "auroc", [cell], n_boot, group, seed, paired=True)
        .groupBy("rep")
        .agg(difference("value").alias("value"))
        .filter(F.col("value").isNotNull())
    )
    interval = percentile_interval(reps)
    row = interval.select(F.struct(*interval.columns)).scalar()
    point = auroc(two, [cell]).agg(difference("auroc").alias("delta"))
    away = (F.col("ci_lo") > 0) | (F.col("ci_hi") < 0)
    verdict = F.when(away & (F.col("delta") >= threshold), F.lit("A")).otherwise(F.lit("B"))
    return point.withColumn("__i", row).select("delta", "__i.*").withColumn("verdict", verdict)


def holm_adjust(p_values: DataFrame, p: str = "p_value", order: Sequence[str] = ()) -> DataFrame:
    """Step-down adjusted p-values over one family of tests. The family is the list of
    cells under comparison (fifteen in a full audit), one row each."""
    by_p = Window.orderBy(p, *order)
    m = F.count(F.lit(1)).over(Window.partitionBy())
    stepped = p_values.withColumn("rank", F.row_number().over(by_p)).withColumn(
        "scaled", F.col(p) * (m - F.col("rank") + 1)
    )
    so_far = F.max("scaled").over(by_p.rowsBetween(Window.unboundedPreceding, 0))
    return stepped.withColumn("p_adjusted", F.least(F.lit(1.0), so_far)).drop("scaled")
