import pytest
from pyspark.sql import functions as F

from leakaudit.operators import audits
from leakaudit.sources import tables


def test_rewriting_a_table_changes_nothing(spark, tmp_path):
    df = spark.range(50).withColumn("x", F.col("id") * 2)
    for _ in range(2):
        tables.write_table(df, str(tmp_path / "t"))
        assert spark.read.parquet(str(tmp_path / "t")).count() == 50


def test_cohort_layout_is_checked(spark, tmp_path):
    columns = [f"CAST(NULL AS {f.dataType.simpleString()}) AS {f.name}" for f in tables.COHORT_SCHEMA.fields]
    good = spark.range(1).selectExpr(*columns)
    tables.write_table(good.withColumn("more", F.lit(1)), str(tmp_path / "c"), tables.COHORT_SCHEMA)
    assert spark.read.parquet(str(tmp_path / "c")).columns == tables.COHORT_SCHEMA.fieldNames()
    zoned = good.withColumn("intime", F.col("intime").cast("timestamp"))
    with pytest.raises(TypeError, match="intime"):
        tables.write_table(zoned, str(tmp_path / "d"), tables.COHORT_SCHEMA)


def test_summary_and_row_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5)], "metric string, value double")
    tables.write_rows_csv(df, str(tmp_path / "csv"))
    tables.write_summary_json(df, str(tmp_path / "json"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).collect() == [("a", "1.5")]
    assert spark.read.json(str(tmp_path / "json")).select("metric", "value").collect() == [("a", 1.5)]


def test_bound_parameters(spark):
    df = spark.range(10)
    got = tables.run_sql(spark, "SELECT id FROM {t} WHERE id > :least AND ':x' = ':x'", {"least": 7}, t=df)
    assert sorted(r.id for r in got.collect()) == [8, 9]
    with pytest.raises(ValueError, match="most"):
        tables.run_sql(spark, "SELECT id::int FROM {t} WHERE id < :most", {}, t=df)


def test_missing_table_is_none(spark):
    assert tables.optional_table(spark, "no_such_table_here") is None


def test_stage_is_built_once_per_key(spark):
    calls = []

    def build(n):
        calls.append(n)
        return spark.range(n)

    for n in (3, 3, 5, 3):
        assert tables.stage(spark, "test_stage/keyed", lambda n=n: build(n), key=f"v{n}").count() == n
    assert calls == [3, 5]
    assert tables.stage(spark, "test_stage/keyed", lambda: build(4), key="v3", fresh=True).count() == 4
    tables.drop_stages(spark, "test_stage")
    assert tables.stage(spark, "test_stage/keyed", lambda: build(6), key="v3").count() == 6


def test_other_input_gives_another_stage(spark, tmp_path):
    for n in (1, 5):  # rows that come from no file are never taken for others
        assert tables.stage(spark, "test_stage/literal", lambda n=n: spark.createDataFrame([(i,) for i in range(n)], "x int")).count() == n
    path = str(tmp_path / "t")
    for n in (2, 7):
        spark.range(n).write.mode("overwrite").parquet(path)
        assert tables.stage(spark, "test_stage/files", lambda: spark.read.parquet(path)).count() == n


def test_a_second_session_reads_the_stages_of_the_first(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(4).write.parquet(path)
    tables.stage(spark, "test_stage/restart", lambda: spark.read.parquet(path), key=tables.fingerprint(spark, spark.read.parquet(path), "seed"))
    other = spark.newSession()
    key = tables.fingerprint(other, other.read.parquet(path), "seed")

    def never():
        raise AssertionError

    assert tables.stage(other, "test_stage/restart", never, key=key).count() == 4
    assert key != tables.fingerprint(other, other.read.parquet(path), "another seed")


def test_layouts_follow_the_files(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "t.parquet"))
    assert tables.read_table(spark, str(tmp_path), "t").columns == ["id"]
    spark.range(2).selectExpr("id AS other").write.mode("overwrite").parquet(str(tmp_path / "t.parquet"))
    assert sorted(r.other for r in tables.read_table(spark, str(tmp_path), "t").collect()) == [0, 1]


def test_shape_counts_on_request(spark, capsys):
    assert tables.shape(spark.range(1500), "numbers") == (1500, 1)
    assert capsys.readouterr().out == "numbers: 1,500 rows, 1 columns\n"


def test_release_guard(spark):
    rows = [(s, "a" if s < 30 else "b", float(s)) for s in range(32)] * 2
    df = spark.createDataFrame(rows, "stay_id long, grp string, x double")
    kept = audits.aggregate_release(df, ["grp"], "stay_id", {"mean_x": F.avg("x")}).collect()
    assert [(r.grp, r.n_entities) for r in kept] == [("a", 30)]
    with pytest.raises(ValueError, match="stay_id"):
        audits.aggregate_release(df, ["stay_id"], "stay_id", {})
    with pytest.raises(ValueError, match="last_id"):
        audits.aggregate_release(df, ["grp"], "stay_id", {"last_id": F.max("stay_id")})


def test_histogram_closes_the_last_bin_and_lists_empty_ones(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("a", 3.0), ("b", 5.0)], "tag string, x double")
    got = {(r.tag, r.bin_no): r.n for r in audits.histogram(df, "tag", "x", 3).collect()}
    assert got == {("a", 0): 1, ("a", 1): 1, ("a", 2): 1, ("b", 0): 0, ("b", 1): 1, ("b", 2): 0}


def test_bands_are_right_closed_and_all_listed(spark):
    rows = [("w", t, d) for t, d in [(5, True), (6, False), (10, True), (24, True), (None, True)]]
    df = spark.createDataFrame(rows, "window string, sofa_total int, dose_determined boolean")
    got = {r.band_no: (r.n, r.pct_dose_determined) for r in audits.by_severity(df).collect()}
    assert got == {1: (1, 1.0), 2: (2, 0.5), 3: (0, None), 4: (1, 1.0)}


def test_key_fanout(spark):
    df = spark.createDataFrame([(1,), (1,), (1,), (2,)], "k int")
    row = audits.key_fanout(df, ["k"]).first()
    assert (row.n_rows, row.n_keys, row.max_copies, row.n_repeated_keys, row.fanout) == (4, 2, 3, 1, 2.0)


def test_wide_plans_are_told_apart(spark, tmp_path):
    path = str(tmp_path / "wide")
    spark.range(5).selectExpr("id", "id % 2 AS x").write.parquet(path)

    def wide(times):
        last = F.col("id") * times
        return spark.read.parquet(path).select(*[(F.col("id") + i).alias(f"c{i}") for i in range(39)], last.alias("c39"))

    assert tables.fingerprint(spark, wide(1)) != tables.fingerprint(spark, wide(1000))
    assert tables.fingerprint(spark, wide(1)) == tables.fingerprint(spark, wide(1))
    for times in (1, 1000):
        assert tables.stage(spark, "test_stage/wide", lambda times=times: wide(times)).agg(F.max("c39")).first()[0] == 4 * times


def test_two_builders_read_one_build(spark):
    def inner():
        tables.stage(spark, "test_stage/twice", lambda: spark.range(3), key="k")  # the other builder is done first
        return spark.range(7)

    assert tables.stage(spark, "test_stage/twice", inner, key="k").count() == 3
    assert tables.stage(spark, "test_stage/twice", lambda: spark.range(9), key="k").count() == 3


def test_a_build_that_breaks_off_leaves_the_last_one(spark, monkeypatch):
    def run(n, **more):
        return tables.stage(spark, "test_stage/crash", lambda: spark.range(n), key="k", **more).count()

    def broken(*args):
        raise OSError("lost before it was published")

    assert run(4) == 4
    monkeypatch.setattr(tables, "_publish", broken)
    with pytest.raises(OSError):
        run(6, fresh=True)
    monkeypatch.undo()
    assert run(6) == 4 and run(6, fresh=True) == 6
    path = tables.stage_path(spark, "test_stage/crash", "k")
    place, fs = tables._path(spark, f"{path}/_published_9")
    fs.create(place, False).close()  # a marker without a name, as a crash may leave it
    assert run(8) == 6 and run(8, fresh=True) == 8
