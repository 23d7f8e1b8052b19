"""What is withheld of released tables must not follow from what is published, totals included."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from leakaudit.operators import audits
from leakaudit.plans import audit


def determined(published: np.ndarray, cells: int) -> set[int]:
    """Cells whose value the published linear sums fix: unit vectors in their row space."""
    rank = np.linalg.matrix_rank(published) if len(published) else 0
    return {i for i in range(cells) if np.linalg.matrix_rank(np.vstack([*published, np.eye(cells)[i]])) == rank}


@pytest.mark.parametrize("sizes", [[30, 40, 5, 60], [3, 4, 50, 24], [23, 24, 25, 26], [40, 50, 60, 70], [0, 5, 90, 30], [2, 3, 4, 30]])
def test_no_withheld_cell_follows_from_the_totals(spark, sizes):
    cells = spark.createDataFrame([("w", i, float(n)) for i, n in enumerate(sizes)], "m string, c int, n double")
    held = spark.createDataFrame([("w", i, n) for i, n in enumerate(sizes) if n], "m string, c int, n_entities long")
    rows = {r.c: r for r in audits.withhold_small(cells, held, ["m", "c"], ["m"]).collect()}
    withheld = {c for c, r in rows.items() if r.withheld}
    assert all((rows[c].n is None) == (c in withheld) for c in rows)
    assert {i for i, n in enumerate(sizes) if 0 < n < 24} <= withheld
    k = len(sizes)
    # an empty band is known to be empty
    published = np.array([np.ones(k), *[np.eye(k)[c] for c in rows if c not in withheld]])
    assert not determined(published, k) & withheld
    assert len(withheld) in (0, sum(0 < n < 24 for n in sizes) + 1)


def test_a_margin_of_one_small_cell_takes_its_total_along(spark):
    rows = spark.createDataFrame(
        [("short", s, 0, 3.0, True, True, 1) for s in range(10)] + [("long", s, b, 3.0 + 4 * b, True, False, 0) for s in range(60) for b in (0, 1)],
        "window string, stay_id long, bin int, sofa_total double, treated boolean, dose_determined boolean, cardio_score_from_dose int",
    )
    got = audits.decomposition_released(rows)
    assert {r.window: r.withheld for r in got["summary"].collect()} == {"short": True, "long": False}
    bands = {(r.window, r.band_no): r for r in got["by_severity"].collect()}
    assert bands["short", 1].withheld and bands["short", 1].n is None and bands["short", 1].band == "(-1, 5]"
    assert bands["long", 1].n == 60 and bands["long", 2].n == 60 and bands["long", 3].n == 0 and not bands["short", 2].withheld
    assert {(r.window, r.bin): r.n for r in got["by_bin"].collect()} == {("short", 0): None, ("long", 0): 60, ("long", 1): 60}


def test_the_paired_test_takes_first_and_last_offset(spark):
    base = spark.range(200).select((F.col("id") % 50).alias("stay_id"), (F.col("id") % 2).cast("int").alias("y"))
    good = base.select("*", (F.col("y") * 0.6 + F.rand(1) * 0.3).alias("score"), F.lit(0).alias("offset_bins"))
    other = [base.select("*", F.rand(k).alias("score"), F.lit(k).alias("offset_bins")) for k in (4, 8)]
    row = audit.decay_paired(good.unionByName(other[0]).unionByName(other[1]), (0, 4, 8), n_boot=30).first()
    assert row.delta > 0.3 and row.ci_lo > 0 and row.verdict == "A"
