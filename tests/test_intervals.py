import random

import pytest

from leakaudit import Grid
from leakaudit.operators import intervals as iv

GRID = Grid(4.0, 24.0, 72.0)
SCHEMA = "stay_id long, start_h double, end_h double"


def merged(spans):
    out = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def hot_spans(n=600):
    """One stay holds most intervals, in copies, beside many small ones."""
    rng = random.Random(3)
    rows = []
    for _ in range(n):
        a = round(rng.uniform(-30, 90) * 60) / 60
        rows.append((0, a, a + round(rng.expovariate(2) * 60) / 60))
    rows += rows[:200]
    for s in range(1, 60):
        for _ in range(rng.randint(1, 6)):
            a = round(rng.uniform(-30, 90) * 60) / 60
            rows.append((s, a, a + rng.choice([0.0, 1.0, 12.0, rng.uniform(0, 40)])))
    return rows


def test_touching_intervals_merge(spark):
    df = spark.createDataFrame([(1, 0.0, 4.0), (1, 4.0, 6.0), (1, 10.0, 12.0)], SCHEMA)
    got = sorted((r.start_h, r.end_h) for r in iv.interval_union(df).collect())
    assert got == [(0.0, 6.0), (10.0, 12.0)]


def test_union_and_coverage_match_brute_force(spark):
    rows = hot_spans()
    df = spark.createDataFrame(rows, SCHEMA)
    by_stay = {}
    for s, a, b in rows:
        by_stay.setdefault(s, []).append((a, b))
    islands = {s: merged(v) for s, v in by_stay.items()}
    got = {}
    for r in iv.interval_union(df).collect():
        got.setdefault(r.stay_id, []).append((r.start_h, r.end_h))
    assert {s: sorted(v) for s, v in got.items()} == islands
    for width in (4.0, 24.0, 10.0):
        for r in iv.window_contamination(df, GRID, width).collect():
            hours = sum(max(0.0, min(r.t, b) - max(r.t - width, a)) for a, b in islands[r.stay_id])
            assert r.contaminated_hours == pytest.approx(hours, abs=1e-6)
            assert r.pct_of_window == pytest.approx(min(1.0, hours / width), abs=1e-6)
    counts = {r.stay_id: r["count"] for r in iv.window_contamination(df, GRID, 24.0).groupBy("stay_id").count().collect()}
    assert counts == {s: GRID.n_bins for s in islands}


def test_overlapping_entities_match_pairs(spark):
    rows = hot_spans(40) + [(900, 1.0, 2.0), (900, 2.0, 3.0), (901, 1.0, 1.0), (901, 1.0, 5.0), (902, 0.0, 9.0), (902, 4.0, 4.0)]
    got = {r.stay_id: r.overlapping for r in iv.overlapping_entities(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {}
    for i, (s, a, b) in enumerate(rows):
        hit = any(j != i and t == s and c < b and a < d for j, (t, c, d) in enumerate(rows))
        want[s] = want.get(s, False) or hit
    assert got == want


def test_union_counts_time_once_and_sum_does_not(spark):
    df = spark.createDataFrame([(1, 2.0, 5.0), (1, 4.0, 6.0)], SCHEMA)
    union = iv.window_contamination(df, GRID, 4.0).filter("t = 8").first()
    summed = iv.window_contamination_summed(df, GRID, 4.0).filter("t = 8").first()
    assert (union.contaminated_hours, union.pct_of_window) == (2.0, 0.5)
    assert (summed.contaminated_hours, summed.pct_of_window) == (3.0, 0.75)


def test_copies_leave_the_union_alone(spark):
    df = spark.createDataFrame([(1, 2.0, 5.0), (1, 4.0, 9.0), (2, 0.0, 1.0)], SCHEMA)
    many = df.union(df).union(df)
    assert sorted(map(tuple, iv.interval_union(many).collect())) == sorted(map(tuple, iv.interval_union(df).collect()))


def test_observed_denominator(spark):
    df = spark.createDataFrame([(1, 0.0, 4.0)], SCHEMA)
    rows = {r.bin: r.pct_of_window for r in iv.window_contamination(df, GRID, 24.0, denominator="observed").collect()}
    assert rows[0] == 1.0 and rows[1] == 0.5 and rows[5] == pytest.approx(4 / 24)


def test_limits_of_the_window(spark):
    df = spark.createDataFrame([(1, 1.0, 71.0)], SCHEMA)
    rows = iv.window_sweep_rows(df, GRID, [0.01, 10_000.0]).filter("bin BETWEEN 0 AND 16").collect()
    assert all(r.pct_of_window == pytest.approx(1.0) for r in rows if r.width == 0.01)
    assert all(r.pct_of_window < 0.01 for r in rows if r.width == 10_000.0)


def test_unit_guard(spark):
    rows = [("norepi", None), ("norepi", "mcg/kg/min"), ("norepi", "mg/hr"), ("vasopressin", "units/hour"), (None, "mg/hr")]
    df = spark.createDataFrame(rows, "drug string, rateuom string")
    kept = sorted(map(tuple, iv.unit_guard(df).collect()), key=str)
    assert kept == sorted([("norepi", "mcg/kg/min"), ("vasopressin", "units/hour"), (None, "mg/hr")], key=str)
    audit = sorted((r.rateuom or "", r.n_dropped) for r in iv.unit_guard_audit(df).collect())
    assert audit == [("", 1), ("mg/hr", 1)]


def test_dose_matrix_zero_and_null(spark):
    rows = [(1, "epi", 0.0, 4.0, 0.2), (1, "epi", 2.0, 8.0, 0.1), (1, "dopamine", 4.0, 8.0, None), (2, "vasopressin", 0.0, 4.0, 1.0)]
    df = spark.createDataFrame(rows, "stay_id long, drug string, start_h double, end_h double, rate double")
    got = {(r.stay_id, r.bin): r for r in iv.dose_matrix(df, GRID).collect()}
    assert len(got) == GRID.n_bins and {s for s, _ in got} == {1}
    assert got[1, 0].epi == 0.2 and got[1, 1].epi == 0.1 and got[1, 2].epi == 0.0
    assert got[1, 0].dopamine == 0.0 and got[1, 1].dopamine is None


def test_actions_and_their_lead(spark):
    stays = spark.createDataFrame([(1,), (2,)], "stay_id long")
    df = spark.createDataFrame([(1, 4.0, 8.0), (3, 0.0, 9.0)], SCHEMA)
    acts = iv.action_bins(stays, df, GRID)
    on = {(r.stay_id, r.bin) for r in acts.filter("action = 1").collect()}
    assert on == {(1, 1)} and acts.count() == 2 * GRID.n_bins
    labels = iv.next_action(acts)
    assert labels.count() == 2 * (GRID.n_bins - 1)
    assert {(r.stay_id, r.bin) for r in labels.filter("action_next = 1").collect()} == {(1, 0)}


def test_dense_coverage_reads_the_intervals_once(spark):
    from leakaudit.plans import catalog, fixture

    sf = "/root/testdata/sf0.001"
    plan = iv.window_contamination(catalog._intervals(spark, sf), fixture.GRID, 24.0)._jdf.queryExecution().optimizedPlan().toString()
    once = iv.interval_union(catalog._intervals(spark, sf))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == once.count("Relation [")
