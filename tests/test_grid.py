import random

from leakaudit import Grid
from leakaudit.operators import grid as g

GRID = Grid(interval=4.0, lookback=24.0, horizon=72.0)


def placed(df):
    return {(r["i"], r["bin"]) for r in df.select("i", "bin").collect()}


def brute(n, test):
    return {(i, b) for i in range(n) for b in range(GRID.n_bins) if test(i, (b + 1) * GRID.interval)}


def test_points_fall_in_half_open_trailing_windows(spark):
    rng = random.Random(7)
    hours = [float(h) for h in range(-26, 76)] + [rng.uniform(-30, 80) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(hours)), "i int, h double")
    for width in (4.0, 24.0, 10.0):
        want = brute(len(hours), lambda i, t, w=width: t - w <= hours[i] < t)
        assert placed(g.point_bins(df, "h", width, GRID)) == want


def test_intervals_touch_bins_strictly(spark):
    rng = random.Random(8)
    spans = [(4.0, 8.0), (8.0, 8.0), (-5.0, 0.0), (-5.0, 0.1), (70.0, 99.0)]
    spans += [(a, a + rng.choice([0, 1, 4, rng.uniform(0, 40)])) for a in (rng.uniform(-20, 80) for _ in range(300))]
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(spans)], "i int, s double, e double")
    want = brute(len(spans), lambda i, t: spans[i][0] < t and spans[i][1] > t - GRID.interval)
    assert placed(g.touching_bins(df, "s", "e", GRID)) == want
    assert {b for i, b in want if i == 0} == {1}


def test_covered_windows_reach_every_overlap(spark):
    rng = random.Random(9)
    spans = [(a, a + rng.uniform(0, 30)) for a in (rng.uniform(-40, 80) for _ in range(300))]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(spans)], "i int, s double, e double")
    want = brute(len(spans), lambda i, t: min(t, spans[i][1]) - max(t - 24, spans[i][0]) > 0)
    assert want <= placed(g.covered_windows(df, "s", "e", 24.0, GRID))


def test_windowed_statistics(spark):
    rows = [(1, "creatinine", -1.0, 9.0), (1, "creatinine", 3.0, 1.0), (1, "platelets", 3.0, 5.0),
            (1, "platelets", 2.0, 7.0), (1, "sbp", 1.0, 10.0), (1, "sbp", 2.0, 20.0)]
    df = spark.createDataFrame(rows, "stay_id long, feature string, hours_from_admit double, value double")
    stats = {"creatinine": "max", "platelets": "min"}
    short = g.windowed_features(df, GRID, 4.0, stats)
    assert {(r.feature, r.bin): r.value for r in short.collect()} == {
        ("creatinine", 0): 1.0, ("platelets", 0): 5.0, ("sbp", 0): 15.0,
    }
    # The point before the origin is seen by longer windows only.
    long = {(r.feature, r.bin): r.value for r in g.windowed_features(df, GRID, 24.0, stats).collect()}
    assert long["creatinine", 0] == 9.0 and long["creatinine", 5] == 1.0 and ("creatinine", 6) not in long
    wide = g.windowed_wide(df, GRID, 24.0, stats, ["creatinine", "platelets", "sbp", "ph"])
    again = g.wide_features(g.windowed_features(df, GRID, 24.0, stats), ["creatinine", "platelets", "sbp", "ph"])
    assert sorted(map(tuple, wide.collect())) == sorted(map(tuple, again.collect()))
    assert wide.filter("ph IS NOT NULL").isEmpty()


def test_decision_grid_bounds(spark):
    row = g.decision_grid(spark.createDataFrame([(5,)], "stay_id long"), GRID).filter("bin = 1").first()
    assert (row.decision_time, row.short_start, row.long_start) == (8.0, 4.0, -16.0)
