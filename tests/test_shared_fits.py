"""The shared fits against independent ones: MLlib, a plain grower of trees, a Newton solver."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leakaudit.operators import logistic, metrics, probes, trees
from leakaudit.operators.probes import ProbeSettings
from leakaudit.operators.resample import group_folds

VARIANTS = {"with": ["signal", "step", "noise"], "without": ["noise", "step"]}
COLUMNS = ["signal", "step", "noise"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    rows = []
    for s in range(120):
        for b in range(8):
            signal, step, noise = rng.normal(), float(rng.integers(0, 4)), rng.normal()
            y = int(rng.random() < 1 / (1 + np.exp(1.0 - 1.6 * signal - 0.8 * (step == 2))))
            rows.append((s, b, y, float(signal), step, float(noise)))
    return group_folds(spark.createDataFrame(rows, "stay_id long, bin int, y int, signal double, step double, noise double"), 3).cache()


def plain_tree(x, s, w, t, rows, depth, leaf):
    """A regression tree over binned columns, cut by cut."""
    value = leaf(s[rows].sum(), w[rows].sum(), t[rows].sum())
    best = None
    if depth:
        base = s[rows].sum() ** 2 / w[rows].sum()
        for c in range(x.shape[1]):
            for cut in range(x[rows, c].max()):
                left = rows[x[rows, c] <= cut]
                right = rows[x[rows, c] > cut]
                if w[left].sum() > 0 and w[right].sum() > 0:
                    gain = s[left].sum() ** 2 / w[left].sum() + s[right].sum() ** 2 / w[right].sum() - base
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = (gain, c, cut, left, right)
    if best is None:
        return lambda z: value
    low, high = (plain_tree(x, s, w, t, r, depth - 1, leaf) for r in best[3:])
    return lambda z: low(z) if z[best[1]] <= best[2] else high(z)


def test_boosting_follows_a_plain_one(spark, table):
    rounds, depth = 12, 3  # past one renewal of the margins' table
    out = trees.boosted(table, COLUMNS, VARIANTS, ["stay_id", "bin"], rounds, depth, 16)
    got = {(r.variant, r.stay_id, r.bin): r.score for r in out.collect()}
    assert len(got) == 2 * table.count()
    rows = trees.binned(table, COLUMNS, ["stay_id", "bin"], 16).collect()
    x = np.array([list(r.x) for r in rows])
    y, fold = np.array([r.y for r in rows]), np.array([r.fold for r in rows])
    leaf = lambda s, w, t: s / t if t else 0.0
    for variant, columns in VARIANTS.items():
        own = x[:, [COLUMNS.index(c) for c in columns]]
        for f in range(3):
            train = np.flatnonzero(fold != f)
            share = y[train].mean()
            margin = np.full(len(y), np.log(share / (1 - share)))
            for _ in range(rounds):
                p = 1 / (1 + np.exp(-margin))
                grown = plain_tree(own, y - p, np.ones(len(y)), p * (1 - p), train, depth, leaf)
                margin += 0.1 * np.array([grown(z) for z in own])
            for i in np.flatnonzero(fold == f):
                assert got[variant, rows[i].stay_id, rows[i].bin] == pytest.approx(1 / (1 + np.exp(-margin[i])), abs=1e-9)


def test_a_forest_of_all_columns_follows_a_plain_tree(spark, table):
    """One column per variant leaves nothing to choose; the drawn rows are the hashed counts."""
    one = {"a": ["signal"]}
    weights = {(r["fold"], r["y"]): r["weight"] for r in probes.class_weights(table, k=3).collect()}
    got = {(r.stay_id, r.bin): r.score for r in trees.forests(table, ["signal"], one, ["stay_id", "bin"], 3, 4, weights, 16).collect()}
    rows = trees.binned(table, ["signal"], ["stay_id", "bin"], 16).collect()
    x, y, fold = np.array([list(r.x) for r in rows]), np.array([r.y for r in rows]), np.array([r.fold for r in rows])
    h = np.array([r.h for r in rows]).view(np.uint64)
    total = np.zeros(len(y))
    for number in range(3):
        u = trees._mix(h ^ trees._mix(np.full(1, number, np.uint64))) >> np.uint64(11)
        drawn = np.searchsorted(trees._POISSON, u / float(1 << 53), "right")
        assert 0.8 < drawn.mean() < 1.2
        for f in range(3):
            w = np.array([weights[f, v] for v in y]) * drawn
            train = np.flatnonzero((fold != f) & (w > 0))
            grown = plain_tree(x, w * y, w, w, train, 4, lambda s, w, t: s / w)
            for i in np.flatnonzero(fold == f):
                total[i] += grown(x[i])
    for i, r in enumerate(rows):
        assert got[r.stay_id, r.bin] == pytest.approx(total[i] / 3, abs=1e-9)


def test_driver_and_exchange_agree(spark, table, monkeypatch):
    run = lambda: sorted((r.variant, r.stay_id, r.bin, round(r.score, 9)) for r in trees.boosted(table, COLUMNS, VARIANTS, ["stay_id", "bin"], 3, 2).collect())
    gathered = run()
    monkeypatch.setattr(trees, "FEW_TASKS", 0)
    monkeypatch.setattr(trees, "_CELLS_AT_ONCE", 500)
    assert run() == gathered


def test_order_agrees_with_separate_fits(table):
    quick = ProbeSettings(trees=60, boosting_rounds=20, folds=3)
    shared = probes.out_of_fold(table, VARIANTS, ("logreg", "rf", "gb"), quick)
    apart = probes.separate_fits(table, VARIANTS, ("logreg", "rf", "gb"), quick)
    both = shared.join(apart.withColumnRenamed("score", "other"), ["variant", "probe", "stay_id", "bin"])
    found = {(r.variant, r.probe): r for r in both.groupBy("variant", "probe").agg(F.corr("score", "other").alias("c"), F.count("*").alias("n")).collect()}
    assert len(found) == 6 and all(r.n == table.count() for r in found.values())
    assert all(r.c > (0.999 if p == "logreg" else 0.9) for (v, p), r in found.items() if v == "with"), found
    auc = [{(r.variant, r.probe): r.auroc for r in metrics.auroc(df, ["variant", "probe"]).collect()} for df in (shared, apart)]
    assert all(abs(auc[0][k] - auc[1][k]) < 0.03 for k in auc[0])


def test_trees_of_one_class_or_no_rows(spark, table):
    same = table.withColumn("y", F.lit(1))
    assert all(r.score > 0.99 for r in trees.boosted(same, COLUMNS, VARIANTS, ["stay_id", "bin"], 2, 2).collect())
    assert trees.boosted(table.limit(0), COLUMNS, VARIANTS, ["stay_id", "bin"], 2, 2).count() == 0
    assert trees.forests(table.limit(0), COLUMNS, VARIANTS, ["stay_id", "bin"], 2, 2, {}).count() == 0


def newton(x, y):
    n, n1 = len(y), y.sum()
    w = np.where(y == 1, n / (2 * n1), n / (2 * (n - n1)))
    a, beta = np.column_stack([x, np.ones(n)]), np.zeros(x.shape[1] + 1)
    penalty = np.array([1.0] * x.shape[1] + [0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-a @ beta))
        beta -= np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + np.diag(penalty), a.T @ (w * (p - y)) + penalty * beta)
    return beta


def test_shared_newton_steps_and_certificate(spark, table):
    parts = table.withColumn("part", F.lit(0)).unionByName(table.withColumn("y", F.when(F.col("bin") % 3 == 0, 1 - F.col("y")).otherwise(F.col("y"))).withColumn("part", F.lit(4)))
    cells = logistic.cells_of(parts, VARIANTS, "part")
    found = logistic.fit(parts, cells, "part")
    pdf = parts.toPandas()
    assert len(found) == 2 * 2 * 3
    for i, beta in enumerate(found):
        own = pdf[(pdf.part == cells.part[i]) & (pdf.fold != cells.fold[i])]
        assert beta == pytest.approx(newton(own[[cells.columns[j] for j in cells.chosen[i]]].to_numpy(), own.y.to_numpy()), abs=1e-6)
    told = logistic.certificate(parts, cells, found, "part").collect()
    assert len(told) == 12 and all(r.converged for r in told)
    off = logistic.certificate(parts, cells, [b + 0.01 for b in found], "part").collect()
    assert not any(r.converged for r in off)
    scored = logistic.score(parts, cells, found, ["stay_id", "bin"], "part")
    assert scored.columns == ["variant", "stay_id", "bin", "part", "y", "score"] and scored.count() == 2 * pdf.shape[0]


def test_steps_that_overshoot_are_halved(spark):
    rows = [(i, 0, int(i % 50 == 0), i % 3, 1000.0 * (i % 50 == 0) + (i % 7)) for i in range(600)]
    far = spark.createDataFrame(rows, "stay_id long, bin int, y int, fold int, x double")
    cells = logistic.cells_of(far, {"v": ["x"]}, None)
    found = logistic.fit(far, cells)
    assert all(r.converged for r in logistic.certificate(far, cells, found).collect())


def test_trees_walk_alike_either_way(monkeypatch):
    """Question by question over many rows, or step by step over few; nodes that aren't split keep their rows."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 32, (700, 9)).astype(np.uint8)
    column, cut = rng.integers(-1, 9, (12, 63)).astype(np.int16), rng.integers(0, 32, (12, 63)).astype(np.uint8)
    for depth in range(7):
        monkeypatch.setattr(trees, "_MANY", 1)
        fast = trees.walk(x, column, cut, depth)
        monkeypatch.setattr(trees, "_MANY", 1 << 30)
        assert (fast == trees.walk(x, column, cut, depth)).all()


@pytest.mark.parametrize("level", [0, 1, 2])
def test_shared_sums_are_those_of_the_rows(level):
    """Histograms by matrix products and by shared draws, against one addition per row."""
    rng = np.random.default_rng(level)
    n, bins, sets = 300, 8, (np.array([0, 2, 3]), np.array([1, 3]))
    x, y, fold, h = rng.integers(0, bins, (n, 4)).astype(np.uint8), rng.integers(0, 2, n), rng.integers(0, 2, n), rng.integers(0, 1 << 60, n)
    batch = pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), pa.array(y), pa.array(fold), pa.array(h)], names=["x", "y", "fold", "h"])
    every = np.array([(v, f, k) for v in (0, 1) for f in (0, 1) for k in (0, 5)])
    for more in ({"considered": 1, "weights": np.array([[0.7, 1.5], [0.6, 2.0]])}, {"prior": rng.normal(size=len(every))}):
        g = trees._empty(sets, *every.T, 3, seed=4, **more)
        for t in range(len(every)):
            for i in range((1 << level) - 1):
                g.column[t, i], g.cut[t, i] = rng.choice([-1, *sets[every[t, 0]]]), rng.integers(1, bins)
        g = trees.replace(g, level=level, value=None)
        nodes, width = 1 << level, g.width
        asked = np.zeros((len(every), nodes, width), np.int64)
        want = np.zeros((2 if g.prior is None else 3, len(every), nodes, width, bins))
        for t, (_, f, k) in enumerate(every):
            own = g.choice(t)
            asked[t, :, : own.shape[1]] = own
            for i in range(n):
                node = int(trees.walk(x[i : i + 1], g.column[t : t + 1], g.cut[t : t + 1], level)[0, 0]) - (nodes - 1)
                if fold[i] == f or node < 0:
                    continue
                if g.prior is None:
                    u = trees._mix(np.array([h[i]], np.uint64) ^ trees._mix(np.array([k], np.uint64) + np.uint64(4 << 20))) >> np.uint64(11)
                    w = g.weights[f, y[i]] * np.searchsorted(trees._POISSON, u / float(1 << 53), "right")[0]
                    stats = (w * y[i], w)
                else:
                    p = 1 / (1 + np.exp(-g.prior[t]))
                    stats = (y[i] - p, 1.0, p * (1 - p))
                for j, c in enumerate(own[node]):
                    want[:, t, node, j, x[i, c]] += stats
        parts = iter([batch.slice(0, 110), batch.slice(110)])
        got = trees._forest_sums(g, asked, bins, parts) if g.prior is None else trees._boosted_sums(g, bins, parts)
        assert np.allclose(got.reshape(want.shape), want, rtol=1e-12, atol=1e-12)


def alike(rng, n):
    """A batch of n rows of few kinds, the same sorted by kind, and the kinds with their numbers."""
    x, y, fold, h = rng.integers(0, 2, (n, 3)).astype(np.uint8), rng.integers(0, 2, n), rng.integers(0, 2, n), rng.integers(0, 1 << 60, n)
    order = np.lexsort((fold, y, *x.T))
    names = ["x", "y", "fold", "h"]
    every, sorted_ = (
        pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x[i]], pa.binary()), *[pa.array(c[i]) for c in (y, fold, h)]], names=names) for i in (slice(None), order)
    )
    kinds, counts = np.unique(np.column_stack([x, y, fold]), axis=0, return_counts=True)
    cells = [pa.array([r[:3].astype(np.uint8).tobytes() for r in kinds], pa.binary()), pa.array(kinds[:, 3]), pa.array(kinds[:, 4]), pa.array(counts)]
    return every, sorted_, pa.RecordBatch.from_arrays(cells, names=["x", "y", "fold", "n"])


def test_rows_that_are_alike_count_as_many():
    rng = np.random.default_rng(5)
    every, _, kinds = alike(rng, 400)
    g = trees._empty((np.array([0, 1, 2]),), np.zeros(2, int), np.array([0, 1]), np.zeros(2, int), 2, prior=np.array([-0.4, 0.2]))
    g.column[:, 0] = 1
    g = trees.replace(g, level=1, value=None)
    assert kinds.num_rows <= 32
    assert np.allclose(trees._boosted_sums(g, 4, iter([kinds])), trees._boosted_sums(g, 4, iter([every])), rtol=1e-12, atol=1e-9)


def test_a_forest_adds_the_draws_of_neighbours(monkeypatch):
    rng = np.random.default_rng(6)
    every, ordered, kinds = alike(rng, 400)
    g = trees._empty((np.array([0, 1, 2]),), np.zeros(4, int), np.array([0, 1, 0, 1]), np.array([0, 0, 3, 3]), 2, considered=3, weights=np.ones((2, 2)), seed=2)
    found = [f for f in trees._kinds(g, [0, 3], iter([ordered.slice(0, 150), ordered.slice(150)]))]
    assert sum(len(f[1]) for f in found) <= kinds.num_rows + 1
    h = every.column("h").to_numpy().view(np.uint64)
    assert [sum(f[3][j].sum() for f in found) for j in (0, 1)] == [trees._draws(h, n, 2).sum() for n in (0, 3)]
    asked = np.broadcast_to(np.arange(3), (4, 1, 3))
    whole = trees._forest_sums(g, asked, 4, iter([every]))
    monkeypatch.setattr(trees, "_KINDS_AT_ONCE", 7)
    assert np.array_equal(trees._forest_sums(g, asked, 4, iter([ordered.slice(i, 40) for i in range(0, 400, 40)])), whole)


def test_draws_are_those_of_the_distribution():
    h = np.random.default_rng(7).integers(0, 1 << 62, 50000).view(np.uint64)
    u = trees._mix(h ^ trees._mix(np.array([9], np.uint64) + np.uint64(3 << 20))) >> np.uint64(11)
    drawn = trees._draws(h, 9, 3)
    assert drawn.max() > 5 and (drawn == np.searchsorted(trees._POISSON, u / float(1 << 53), "right")).all()


def test_binned_rows_are_dealt_over_the_cores(spark):
    """A stage table of one file, of one kind of rows, must not leave a fit to one task."""
    table = spark.range(20000).coalesce(1).selectExpr("id AS stay_id", "1 AS bin", "0 AS y", "0 AS fold", "2.0D AS a")
    rows = trees.binned(table, ["a"], ["stay_id", "bin"])
    held = [r["n"] for r in rows.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(held) == 20000 and len(held) >= 4 and max(held) < 8000
