from datetime import datetime

from leakaudit.plans import audit, clinical


def test_source_tables_become_audit_inputs(spark):
    t = lambda h: datetime(2150, 1, 1 + h // 24, h % 24)
    ntz = "timestamp_ntz"
    stays = spark.createDataFrame([(1, 10, 100, t(0), t(60), 2.5, "MICU"), (2, 20, 200, t(0), t(60), 2.5, "NICU")],
        f"subject_id long, hadm_id long, stay_id long, intime {ntz}, outtime {ntz}, los double, first_careunit string")
    patients = spark.createDataFrame([(1, 60), (2, 61)], "subject_id long, anchor_age int")
    admissions = spark.createDataFrame([(10, None, 0), (20, None, 0)], f"hadm_id long, deathtime {ntz}, hospital_expire_flag int")
    drips = [(100, 221906, t(1), t(6), 0.2, "mcg/kg/min", 5.0), (100, 221289, t(2), t(6), 0.2, "mg/h", 5.0)]
    inputs = spark.createDataFrame(drips, f"stay_id long, itemid long, starttime {ntz}, endtime {ntz}, rate double, rateuom string, amount double")
    chart = spark.createDataFrame([(100, 220181, t(2), 60.0, 0), (100, 223835, t(2), 40.0, 0), (100, 220045, t(2), -1.0, 0)],
        f"stay_id long, itemid long, charttime {ntz}, valuenum double, warning int")
    labs = spark.createDataFrame([(10, 50821, t(2), 80.0)], f"hadm_id long, itemid long, charttime {ntz}, valuenum double")
    s = clinical.clinical_sources(stays, patients, admissions, inputs, chart, labs)
    assert [r.stay_id for r in s.cohort.collect()] == [100]
    assert [(r.drug, r.start_h, r.end_h) for r in s.intervals.select("drug", "start_h", "end_h").collect()] == [("norepi", 1.0, 6.0)]
    found = {(r.feature, r.value) for r in audit.measurements_long(s).collect()}
    assert found == {("mbp", 60.0), ("fio2", 0.4), ("pao2", 80.0)}
    row = {r.bin: r for r in audit.scores(s, "short").collect()}[0]
    assert (row.pf_ratio, row.sofa_resp, row.cardio_score_from_dose) == (200.0, 2, 4)
    assert s.grid.interval == 4 and s.grid.lookback == 24 and s.grid.horizon == 72
