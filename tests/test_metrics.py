import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leakaudit.operators import metrics, resample, states
from leakaudit.operators.quantiles import describe, exact_quantiles

PRED = "stay_id long, bin int, y int, score double"


def predictions(n=80, bins=6, seed=1, digits=2):
    rng = random.Random(seed)
    rows = []
    for s in range(n):
        lean = rng.random()
        for b in range(bins):
            y = int(rng.random() < lean)
            rows.append((s, b, y, round(min(1.0, max(0.0, 0.5 * lean + 0.3 * y + rng.gauss(0, 0.2))), digits)))
    return rows


def rank_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))


@pytest.mark.parametrize("digits", [1, 9])
def test_auroc_with_ties(spark, digits):
    rows = predictions(digits=digits)
    y, s = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    df = spark.createDataFrame(rows, PRED)
    assert metrics.auroc(df).first().auroc == pytest.approx(rank_auc(y, s))
    assert metrics.auroc(df, buckets=False).first().auroc == pytest.approx(rank_auc(y, s))
    cells = df.withColumn("cell", F.col("bin") % 2)
    for r in metrics.auroc(cells, ["cell"]).collect():
        keep = np.array([row[1] % 2 == r.cell for row in rows])
        assert r.auroc == pytest.approx(rank_auc(y[keep], s[keep]))


def test_auroc_of_one_class_is_null(spark):
    df = spark.createDataFrame([(1, 0, 1, 0.3), (1, 1, 1, 0.4)], PRED)
    assert metrics.auroc(df).first().auroc is None


def test_auroc_when_one_score_dominates(spark):
    rows = [(i, 0, i % 3 % 2, 0.25) for i in range(900)] + [(i, 1, i % 2, i / 900) for i in range(900)]
    y, s = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    assert metrics.auroc(spark.createDataFrame(rows, PRED)).first().auroc == pytest.approx(rank_auc(y, s))


def test_threshold_metrics(spark):
    df = spark.createDataFrame([(1, 0, 1, 0.9), (1, 1, 1, 0.5), (1, 2, 0, 0.6), (1, 3, 0, 0.1)], PRED)
    assert metrics.balanced_accuracy(df).first().balanced_acc == 0.5
    assert metrics.macro_f1(df).first().macro_f1 == pytest.approx(0.5)


def test_calibration_leaves_out_certainty(spark):
    df = spark.createDataFrame([(1, 0, 1, 1.0), (1, 1, 0, 0.25), (1, 2, 1, 0.25), (1, 3, 1, 0.0)], PRED)
    want = (abs(1 - 0.5) + abs(1 - 0.0)) / 4
    assert metrics.calibration_error(df).first().ece == pytest.approx(want)


def test_weights_are_repetition(spark):
    rows = predictions(20)
    twice = [r for r in rows for _ in range(1 + r[0] % 3)]
    df = spark.createDataFrame(rows, PRED).withColumn("weight", 1 + F.col("stay_id") % 3)
    plain = spark.createDataFrame(twice, PRED)
    for name, f in metrics.METRICS.items():
        assert f(df).first()[name] == pytest.approx(f(plain).first()[name])


def test_cluster_bootstrap_by_hand(spark):
    rows = predictions(25)
    df = spark.createDataFrame(rows, PRED)
    weights = resample.bootstrap_weights(df.select("stay_id").distinct(), 12)
    drawn = {}
    for r in weights.collect():
        drawn.setdefault(r.rep, {})[r.stay_id] = r.weight
    assert len(drawn) == 12 and all(sum(w.values()) == 25 for w in drawn.values())
    reps = {r.rep: r.value for r in metrics.bootstrap_replicates(df, n_boot=12).collect()}
    for rep, w in drawn.items():
        again = [r for r in rows for _ in range(w.get(r[0], 0))]
        y, s = np.array([r[2] for r in again]), np.array([r[3] for r in again])
        assert reps[rep] == pytest.approx(rank_auc(y, s))
    ci = metrics.cluster_bootstrap(df, n_boot=12).first()
    want = np.percentile(list(reps.values()), [2.5, 97.5])
    assert [ci.ci_lo, ci.ci_hi] == pytest.approx(list(want), abs=1e-8) and ci.n_reps == 12


def test_one_class_replicates_are_skipped(spark):
    df = spark.createDataFrame([(1, 0, 1, 0.9), (2, 0, 0, 0.1)], PRED)
    assert 0 < metrics.bootstrap_replicates(df, n_boot=40).count() < 40
    assert metrics.bootstrap_replicates(df, "ece", n_boot=40).count() == metrics.bootstrap_replicates(df, n_boot=40).count()


@pytest.mark.parametrize("n", [1, 2, 7, 10, 101, 3000])
def test_exact_quantiles(spark, n):
    rng = np.random.default_rng(n)
    values = np.where(rng.random(n) < 0.4, 0.5, rng.random(n).round(3))
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    df = spark.createDataFrame([("a", float(v)) for v in values] + [("b", 3.0)], "g string, v double")
    got = {(r.g, r.prob_no): r.quantile for r in exact_quantiles(df, ["g"], "v", probs).collect()}
    assert [got["a", i] for i in range(len(probs))] == pytest.approx(list(np.quantile(values, probs)), abs=1e-8)
    assert all(got["b", i] == 3.0 for i in range(len(probs)))


def test_exact_quantiles_beyond_the_sketch(spark):
    df = spark.range(200_000).select(F.lit("a").alias("g"), F.pow(F.col("id") / 1000.0, 2).alias("v"))
    values = (np.arange(200_000) / 1000.0) ** 2
    probs = [0.001, 0.333, 0.5, 0.977]
    got = {r.prob_no: r.quantile for r in exact_quantiles(df, ["g"], "v", probs).collect()}
    assert [got[i] for i in range(4)] == pytest.approx(list(np.quantile(values, probs)), abs=1e-7)


def test_describe(spark):
    values = [0.0, 0.0, 0.25, 1.0, 1.0]
    row = describe(spark.createDataFrame([("a", v) for v in values], "g string, v double"), ["g"], "v").first()
    assert (row.n, row.min, row.q25, row.q50, row.q75, row.max) == (5, 0.0, 0.0, 0.25, 1.0, 1.0)
    assert row["std"] == pytest.approx(np.std(values, ddof=1))


def test_mutual_information(spark):
    rng = random.Random(5)
    rows = []
    for i in range(600):
        y = rng.randint(0, 1)
        for f, v in (("pair", float(y)), ("noise", rng.random()), ("same", 1.0), ("lean", y + rng.gauss(0, 1))):
            rows.append((i % 40, f, v, y))
    df = spark.createDataFrame(rows, "stay_id long, feature string, value double, y int")
    got = {r.feature: r.mi for r in metrics.mutual_information(df).collect()}
    y = np.array([r[3] for r in rows if r[1] == "lean"])
    # Two distinct values leave no inner edge, hence one bin: what quantile binning
    # with collapsed edges gives, and what a constant column gives.
    assert got["pair"] == got["same"] == 0.0
    assert got["noise"] < 0.05 < got["lean"] < math.log(2)
    x = np.array([r[2] for r in rows if r[1] == "lean"])
    cut = np.searchsorted(np.quantile(x, np.linspace(0, 1, 11))[1:-1], x, side="right")
    want = 0.0
    for b in range(10):
        for c in (0, 1):
            joint = ((cut == b) & (y == c)).mean()
            if joint:
                want += joint * math.log(joint / ((cut == b).mean() * (y == c).mean()))
    assert got["lean"] == pytest.approx(want)


def test_paired_delta_uses_shared_draws(spark):
    base = spark.createDataFrame(predictions(30), PRED)
    two = base.withColumn("k", F.lit(0)).unionByName(base.withColumn("k", F.lit(8)))
    row = metrics.paired_delta(two, "k", 0, 8, n_boot=15).first()
    assert (row.delta, row.ci_lo, row.ci_hi, row.verdict) == (0.0, 0.0, 0.0, "B")
    noise = base.withColumn("k", F.lit(8)).withColumn("score", F.rand(3))
    sharp = base.withColumn("k", F.lit(0)).withColumn("score", F.col("y") * 1.0)
    assert metrics.paired_delta(sharp.unionByName(noise), "k", 0, 8, n_boot=15).first().verdict == "A"


def test_holm(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.5)], "t string, p_value double")
    got = {r.t: r.p_adjusted for r in metrics.holm_adjust(df, order=["t"]).collect()}
    assert got == {"a": pytest.approx(0.04), "c": pytest.approx(0.09), "b": pytest.approx(0.09), "d": pytest.approx(0.5)}


def test_dense_index_and_permutations(spark):
    df = spark.createDataFrame(predictions(), PRED)
    n = df.count()
    index = sorted(r.idx for r in resample.dense_index(df, ["stay_id", "bin"], "t").collect())
    assert index == list(range(n))
    shuffled = resample.permute_label(df, "y", ["stay_id", "bin"])
    total = shuffled.agg(F.sum("y"), F.sum("y_shuffled"), F.count_if(F.col("y") != F.col("y_shuffled"))).first()
    assert total[0] == total[1] and total[2] > n / 5 and shuffled.count() == n
    within = resample.permute_within(df, "y").groupBy("stay_id").agg(F.sum("y").alias("a"), F.sum("y_permuted").alias("b"))
    assert within.filter("a != b").isEmpty()
    again = resample.permute_label(df.repartition(3), "y", ["stay_id", "bin"])
    assert sorted(map(tuple, again.select(*shuffled.columns).collect())) == sorted(map(tuple, shuffled.collect()))


def test_folds_keep_groups_whole(spark):
    df = resample.group_folds(spark.createDataFrame(predictions(400, 2), PRED), 5)
    assert df.groupBy("stay_id").agg(F.count_distinct("fold").alias("k")).filter("k > 1").isEmpty()
    sizes = [r["count"] for r in df.groupBy("fold").count().collect()]
    assert len(sizes) == 5 and min(sizes) > 100


def test_placebo_has_the_label_rate(spark):
    df = resample.placebo_column(spark.createDataFrame(predictions(400), PRED), "y", ["stay_id", "bin"])
    row = df.agg(F.avg("y").alias("y"), F.avg("placebo").alias("p"), F.corr("y", "placebo").alias("c")).first()
    assert abs(row.y - row.p) < 0.05 and abs(row.c) < 0.06


def test_offsets_count_rows_or_bins(spark):
    df = spark.createDataFrame([(1, 0, 0), (1, 2, 1), (1, 3, 0), (2, 1, 1)], "stay_id long, bin int, action_next int")
    rows = {(r.stay_id, r.bin): r.action_shifted for r in states.offset_labels(df, 1).collect()}
    assert rows == {(1, 0): 1, (1, 2): 0}
    bins = {(r.stay_id, r.bin): r.action_shifted for r in states.offset_labels(df, 1, by="bin").collect()}
    assert bins == {(1, 2): 0}


def test_impute_and_scale(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, None, None), (3, 3.0, None)], "stay_id long, a double, b double")
    assert [r.a for r in states.impute_means(df, ["a", "b"]).orderBy("stay_id").collect()] == [1.0, 2.0, 3.0]
    scaled = states.standardize(df.na.fill(2.0), ["a", "b"]).orderBy("stay_id").collect()
    assert [r.a for r in scaled] == pytest.approx([-math.sqrt(1.5), 0.0, math.sqrt(1.5)])
    assert [r.b for r in scaled] == [0.0, 0.0, 0.0]
    fitted = states.impute_means(df, ["a"], fit=df.filter("stay_id = 3")).orderBy("stay_id").collect()
    assert fitted[1].a == 3.0


def test_variants(spark):
    names = states.variant_columns()
    assert {v: len(c) for v, c in names.items()} == {
        "A_full": 25, "B_no_total_sofa": 24, "C_no_cardio_sofa": 24, "D_treatment_decomposed": 25, "E_physiology_only": 23,
    }
    row = {f: 1.0 for f in states.STATE_FEATURES} | {"mbp": 60.0, "sofa_cardio": 4.0, "sofa_total": 9.0}
    df = states.with_map_only(spark.createDataFrame([row]))
    got = df.first()
    assert got[states.MAP_ONLY_CARDIO] == 1.0 and got[states.MAP_ONLY_TOTAL] == 6.0
    assert "sofa_cardio" not in names["D_treatment_decomposed"] and "sofa_total" not in names["D_treatment_decomposed"]


def test_each_cell_draws_from_its_own_groups(spark):
    rows = [("all", g, g % 2, float(g)) for g in range(40)] + [("few", g, g % 2, float(g)) for g in range(10)]
    df = spark.createDataFrame(rows, "cell string, stay_id long, y int, score double")
    from leakaudit.operators.resample import bootstrap_weights

    w = bootstrap_weights(df.select("cell", "stay_id").distinct(), 20, by=["cell"])
    drawn = {(r.cell, r.rep): r["sum(weight)"] for r in w.groupBy("cell", "rep").sum("weight").collect()}
    assert set(drawn.values()) == {40, 10} and all(n == (40 if c == "all" else 10) for (c, _), n in drawn.items())
    both = {(r.cell, r.rep): r.value for r in metrics.bootstrap_replicates(df, by=["cell"], n_boot=20).collect()}
    alone = {r.rep: r.value for r in metrics.bootstrap_replicates(df.filter("cell = 'few'").drop("cell"), n_boot=20).collect()}
    assert {rep: v for (c, rep), v in both.items() if c == "few"} == alone


def test_one_window_serves_all_offsets(spark):
    rows = spark.createDataFrame([(s, b, (s + b) % 2) for s in range(5) for b in range(0, 12, 1 + s % 3)], "stay_id long, bin int, action_next int")
    many = states.all_offset_labels(rows, (1, 2, 4))
    one = [states.offset_labels(rows, k).withColumn("offset_bins", F.lit(k)) for k in (1, 2, 4)]
    assert sorted(many.collect()) == sorted(r for df in one for r in df.select(many.columns).collect())
    assert many._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1


def test_packed_draws_are_the_weights(spark, monkeypatch):
    """Cells of equal size share draws, blocks are counted apart, and a number above 255 takes a wider vector."""
    monkeypatch.setattr(resample, "_BLOCK", 3)
    monkeypatch.setattr(resample, "_BLOCKS", 4)
    rows = [(c, g) for c, size in (("a", 30), ("b", 30), ("c", 7), ("d", 1)) for g in range(size)]
    df = spark.createDataFrame(rows, "cell string, stay_id long")
    want = {(r.cell, r.stay_id, r.rep): r.weight for r in resample.bootstrap_weights(df, 9, by=["cell"]).collect()}
    found = {}
    for r in resample.bootstrap_vectors(df, 9, by=["cell"]).collect():
        found |= {(r.cell, r.stay_id, rep): w for rep, w in enumerate(r.drawn) if w}
    assert found == want
    wide = np.array([1, 2, 700], np.uint32).tobytes()
    assert resample.drawn_matrix(pa.array([bytes([3, 0, 255]), wide]), 3).tolist() == [[3, 0, 255], [1, 2, 700]]


@pytest.mark.parametrize("metric", ["auroc", "macro_f1", "ece"])
def test_draws_are_never_broadcast(spark, tmp_path, metric):
    """A file of groups looks small to a plan, and what 300 replicates make of it is not: it must not go through the driver."""
    spark.createDataFrame(predictions(40, 2), PRED).write.parquet(str(tmp_path / "p"))
    reps = metrics.bootstrap_replicates(spark.read.parquet(str(tmp_path / "p")), metric)
    joins = [line for line in reps._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in line]
    assert not [line for line in joins if "idx#" in line or "stay_id#" in line]


def test_replicates_of_scores_tied_across_slices(spark, monkeypatch):
    """Scores in long ties, a bucket swept a few rows at a time: each replicate is the area by counting pairs."""
    from leakaudit.operators.resample import bootstrap_vectors, drawn_matrix

    monkeypatch.setattr(metrics, "_ROWS_SWEPT", 5)
    rows = [(g, b, (g * 7 + b * 3) % 5 % 2, float((g + b * b) % 4) if (g + b) % 9 else None) for g in range(30) for b in range(3)]
    rows += [(g, 3, g % 2, 0.5) for g in range(30)]
    frame = spark.createDataFrame(rows, "stay_id long, bin int, y int, score double").filter("score IS NOT NULL")
    got = {r.rep: r.value for r in metrics.bootstrap_replicates(frame, "auroc", n_boot=20).collect()}
    told = bootstrap_vectors(frame.select("stay_id").distinct(), 20).toArrow().combine_chunks()
    drawn = dict(zip(told.column("stay_id").to_pylist(), drawn_matrix(told.column("drawn").combine_chunks(), 20).astype(int)))
    for rep in range(20):
        pos, neg = ([(s, drawn[g][rep]) for g, _, y, s in rows if s is not None and y == k and g in drawn] for k in (1, 0))
        wins = sum(m * n * ((a > b) + 0.5 * (a == b)) for a, m in pos for b, n in neg)
        assert got[rep] == wins / (sum(m for _, m in pos) * sum(n for _, n in neg))


def test_bucket_counts_the_edges_below(spark):
    scores = [0.0, 0.1, 0.1, 0.5, 0.7, 0.9, 1.0, float("nan")] + [i / 3000 for i in range(3000)]
    frame = spark.createDataFrame([(s,) for s in scores], "score double")
    probs = ", ".join(f"{i / 1024!r}D" for i in range(1024))
    edges = frame.selectExpr(f"percentile_approx(score, array({probs}), 4096) e").first().e
    told = metrics.with_score_bucket(frame)
    for r in told.collect():
        assert r.bucket == (1024 if r.score != r.score else sum(e < r.score for e in edges))
    assert "lambda" not in told._jdf.queryExecution().optimizedPlan().toString()
    assert metrics.with_score_bucket(spark.createDataFrame([(None,), (0.5,)], "score double")).filter("score IS NULL").first().bucket == 0


def test_groups_are_hashed_once_each(spark, tmp_path):
    """The hash of a group's place isn't asked of every row before rows become groups."""
    spark.range(100).selectExpr("id % 10 AS stay_id", "id AS bin").write.parquet(str(tmp_path / "t"))
    from leakaudit.operators.resample import bootstrap_vectors

    plan = bootstrap_vectors(spark.read.parquet(str(tmp_path / "t")).select("stay_id").distinct(), 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" in plan and not any("Filter" in line and "md5" in line for line in plan.splitlines())


def test_rounding_is_not_repeated_for_each_edge(spark):
    long = spark.createDataFrame([("a", float(i), i % 2) for i in range(50)] + [("b", None, 1)], "feature string, value double, y int")
    told = metrics.discretize(long, metrics.quantile_edges(long))
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert all("round(" not in line.split("lambdafunction(")[1] for line in plan.splitlines() if "lambdafunction(" in line and "value_bin" in line)
    assert {r.feature: r.n for r in told.groupBy("feature").agg({"value_bin": "max"}).toDF("feature", "n").collect()} == {"a": 9, "b": 0}
    unrolled = metrics.discretize(long, metrics.quantile_edges(long), most=9)
    assert sorted(unrolled.collect()) == sorted(told.collect())
    assert "lambda" not in [line for line in unrolled._jdf.queryExecution().optimizedPlan().toString().splitlines() if "value_bin" in line][0]


def test_draws_formed_in_tasks_are_those_of_pick(spark):
    from leakaudit.functions.hashing import pick

    rows = spark.range(40).selectExpr("id * 977 AS idx").crossJoin(spark.range(7).selectExpr("CAST(id AS INT) AS rep")).orderBy("idx", "rep")
    want = [r.hit for r in rows.select(pick(42, "bootstrap_draw", F.lit(1234567), "rep", "idx").alias("hit")).collect()]
    assert resample._hits(42, 7, np.arange(40) * 977, np.full(280, 1234567)).tolist() == want
    plan = resample.bootstrap_vectors(spark.range(9).selectExpr("id AS stay_id"), 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan.lower()  # no row for each draw before tasks pack them
