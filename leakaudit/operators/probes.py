"""Out-of-fold probe predictions: all variants and folds of a probe are fitted in shared passes over the rows.

``separate_fits`` does the same with one MLlib estimator per variant, probe and fold; it is kept to compare with.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakaudit.operators import logistic, trees
from leakaudit.operators.resample import SEED, group_folds
from leakaudit.operators.trees import BINS


@dataclass(frozen=True)
class ProbeSettings:
    """Full-size defaults; smaller ones make quick runs."""

    trees: int = 300
    tree_depth: int = 6
    boosting_rounds: int = 100
    boosting_depth: int = 3
    max_iter: int = 2000
    tol: float = 1e-6
    folds: int = 5
    seed: int = SEED
    parallel_fits: int = 8
    bins: int = BINS


@dataclass(frozen=True)
class Probe:
    """A factory of estimators, given the settings and the training rows' total weight."""

    make: Callable[[ProbeSettings, float], object]
    balanced: bool = True


def _logreg(s: ProbeSettings, total: float):
    # The penalty of a summed loss with unit strength, for a loss averaged by weight.
    return LogisticRegression(
        featuresCol="x", labelCol="y", weightCol="w", maxIter=s.max_iter, tol=s.tol,
        regParam=1.0 / total, elasticNetParam=0.0, standardization=False,
    )


def _forest(s: ProbeSettings, total: float):
    return RandomForestClassifier(
        featuresCol="x", labelCol="y", weightCol="w", numTrees=s.trees, maxDepth=s.tree_depth,
        featureSubsetStrategy="sqrt", seed=s.seed,
    )


def _boosted(s: ProbeSettings, total: float):
    return GBTClassifier(
        featuresCol="x", labelCol="y", weightCol="w", maxIter=s.boosting_rounds,
        maxDepth=s.boosting_depth, stepSize=0.1, seed=s.seed,
    )


PROBES: dict[str, Probe] = {
    "logreg": Probe(_logreg),
    "rf": Probe(_forest),
    "gb": Probe(_boosted, balanced=False),
}


def class_weights(df: DataFrame, label: str = "y", fold: str = "fold", k: int = 5) -> DataFrame:
    """(fold, y, n, weight): n / (2 n_class) over the rows outside each fold.

    Counted per (fold, class) once - 2k rows - and then added up without the fold.
    """
    counts = df.groupBy(F.col(fold).alias("of"), F.col(label).cast("int").alias("y")).agg(
        F.count(F.lit(1)).alias("m")
    )
    outside = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: f != F.col("of"))
    per = counts.select(F.explode(outside).alias("fold"), "y", "m").groupBy("fold", "y").agg(
        F.sum("m").alias("n_class")
    )
    both = per.groupBy("fold").agg(F.sum("n_class").alias("n"))
    joined = per.join(both, "fold")
    return joined.select("fold", "y", "n_class", "n", (F.col("n") / (2.0 * F.col("n_class"))).alias("weight"))


@dataclass(frozen=True)
class Cell:
    """One variant scored by one probe."""

    variant: str
    probe: str
    columns: Sequence[str] = field(default_factory=tuple)


def out_of_fold(
    table: DataFrame,
    variants: Mapping[str, Sequence[str]],
    probes: Sequence[str] = ("logreg", "rf", "gb"),
    settings: ProbeSettings = ProbeSettings(),
    keys: Sequence[str] = ("stay_id", "bin"),
    part: str | None = None,
) -> DataFrame:
    """(variant, probe, keys..., y, score) for a table of standardised columns, ``y`` and
    the keys, folded by the first key unless it brings its own ``fold``.

    The table should be a stage table: it is read once for every pass. A probe's models of all variants and folds
    share their passes, and the probes run side by side. ``part`` names a column of which every value has models of its
    own (logistic ones only); it is kept as a last column.
    """
    folded = table if "fold" in table.columns else group_folds(table, settings.folds, keys[0], settings.seed)
    columns = list(dict.fromkeys(c for own in variants.values() for c in own))

    def logreg() -> DataFrame:
        cells = logistic.cells_of(folded, variants, part)
        return logistic.score(folded, cells, logistic.fit(folded, cells, part, settings.max_iter), keys, part)

    def forest() -> DataFrame:
        weights = {(r["fold"], r["y"]): r["weight"] for r in class_weights(folded, k=settings.folds).collect()}
        return trees.forests(folded, columns, variants, keys, settings.trees, settings.tree_depth, weights, settings.bins, settings.seed)

    def boosted() -> DataFrame:
        return trees.boosted(folded, columns, variants, keys, settings.boosting_rounds, settings.boosting_depth, settings.bins, settings.seed)

    fits = {"logreg": logreg, "rf": forest, "gb": boosted}
    if part is not None and set(probes) - {"logreg"}:
        raise ValueError("only logistic models are fitted by part")
    with ThreadPoolExecutor(max(1, len(probes))) as pool:
        scored = list(pool.map(lambda p: fits[p](), probes))
    tail = [part] if part else []
    parts = [df.select("variant", F.lit(p).alias("probe"), *keys, "y", "score", *tail) for p, df in zip(probes, scored)]
    return reduce(DataFrame.unionByName, parts)


def separate_fits(
    table: DataFrame,
    variants: Mapping[str, Sequence[str]],
    probes: Sequence[str] = ("logreg", "rf", "gb"),
    settings: ProbeSettings = ProbeSettings(),
    keys: Sequence[str] = ("stay_id", "bin"),
) -> DataFrame:
    """The columns of ``out_of_fold``, from an MLlib fit per variant, probe and fold.

    The table should be a stage table partitioned by fold: each of the variant x probe
    x fold fits reads the other folds and scores its own. What reaches the driver is 2k class counts and
    the fitted models. Fits are independent jobs, submitted from a small thread pool.
    """
    folded = table if "fold" in table.columns else group_folds(table, settings.folds, keys[0], settings.seed)
    folded = folded.withColumn("y", F.col("y").cast("double"))
    weights = {
        (r["fold"], r["y"]): (r["weight"], r["n"])
        for r in class_weights(folded, k=settings.folds).collect()
    }
    cells = [Cell(v, p, tuple(columns)) for v, columns in variants.items() for p in probes]

    def score(cell: Cell, fold: int) -> DataFrame:
        probe = PROBES[cell.probe]
        rows = VectorAssembler(inputCols=list(cell.columns), outputCol="x").transform(folded)
        train = rows.filter(F.col("fold") != fold)
        if probe.balanced:
            w = {y: weights.get((fold, y), (1.0, 0))[0] for y in (0, 1)}
            train = train.withColumn("w", F.when(F.col("y") == 1, F.lit(w[1])).otherwise(F.lit(w[0])))
        else:
            train = train.withColumn("w", F.lit(1.0))
        total = max(n for (f, _), (_, n) in weights.items() if f == fold)
        model = probe.make(settings, float(total)).fit(train.select("x", "y", "w"))
        if cell.probe == "logreg" and model.summary.totalIterations >= settings.max_iter:
            raise RuntimeError(f"{cell.variant}, fold {fold}: no convergence in {settings.max_iter} iterations")
        scored = model.transform(rows.filter(F.col("fold") == fold))
        return scored.select(
            F.lit(cell.variant).alias("variant"),
            F.lit(cell.probe).alias("probe"),
            *keys,
            F.col("y").cast("int").alias("y"),
            vector_to_array("probability")[1].alias("score"),
        )

    present = sorted({f for f, _ in weights})
    jobs = [(cell, fold) for cell in cells for fold in present]
    with ThreadPoolExecutor(settings.parallel_fits) as pool:
        parts = list(pool.map(lambda job: score(*job), jobs))
    return reduce(DataFrame.unionByName, parts)
