"""Reading sources, running SQL with bound parameters, writing results and stages."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from leakaudit.session import shared_dir


_LAYOUTS: dict[tuple, T.StructType] = {}


def _path(spark: SparkSession, path: str):
    """(Hadoop path, its file system)."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def file_facts(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(name, length, modification time) of a file, or of a folder's entries."""
    place, fs = _path(spark, path)
    return sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(place))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table. Its layout is looked up once per session and state of its files:
    inferring it reads footers in a job of its own, and a plan may name a table many times."""
    path = f"{sf_dir}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path, tuple(file_facts(spark, path)))
    if key not in _LAYOUTS:
        _LAYOUTS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_LAYOUTS[key]).parquet(path)


def optional_table(spark: SparkSession, name: str) -> DataFrame | None:
    """The catalog table, or None when the session cannot see one of that name."""
    return spark.table(name) if spark.catalog.tableExists(name) else None


def run_sql(spark: SparkSession, text: str, params: Mapping[str, object] | None = None, **tables: DataFrame) -> DataFrame:
    """A query with ``:name`` parameters, ``IDENTIFIER(:name)`` for table names and
    ``{name}`` for DataFrames. A placeholder without a value fails before running."""
    given = dict(params or {})
    bare = re.sub(r"'(?:[^']|'')*'", "''", text)
    unbound = sorted(set(re.findall(r"(?<![:\w]):([A-Za-z_]\w*)", bare)) - set(given))
    if unbound:
        raise ValueError(f"unbound query parameters: {unbound}")
    return spark.sql(text, args=given, **tables)


def shape(df: DataFrame, label: str | None = None) -> tuple[int, int]:
    """Rows and columns, counted on request only; printed when labelled."""
    rows, columns = df.count(), len(df.columns)
    if label:
        print(f"{label}: {rows:,} rows, {columns} columns")
    return rows, columns


# The explicit cohort layout. Times have no zone: an inferred zoned type would shift
# them, and they would then match nothing.
COHORT_SCHEMA = T.StructType(
    [
        T.StructField("subject_id", T.LongType()),
        T.StructField("hadm_id", T.LongType()),
        T.StructField("stay_id", T.LongType()),
        T.StructField("intime", T.TimestampNTZType()),
        T.StructField("outtime", T.TimestampNTZType()),
        T.StructField("los", T.DoubleType()),
        T.StructField("first_careunit", T.StringType()),
        T.StructField("anchor_age", T.IntegerType()),
        T.StructField("deathtime", T.TimestampNTZType()),
        T.StructField("hospital_expire_flag", T.IntegerType()),
        T.StructField("rn", T.IntegerType()),
    ]
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in its order, or an error naming what differs."""
    have = {f.name: f.dataType for f in df.schema.fields}
    wrong = [f.name for f in schema.fields if have.get(f.name) != f.dataType]
    if wrong:
        raise TypeError(f"columns missing or of another type: {wrong}")
    return df.select(*schema.fieldNames())


def write_table(
    df: DataFrame, path: str, schema: T.StructType | None = None, partition_by: Sequence[str] = ()
) -> None:
    """Replace the table; writing it twice leaves it as it was after the first time."""
    rows = df if schema is None else conform(df, schema)
    rows.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_rows_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_summary_json(df: DataFrame, path: str) -> None:
    """Tidy summary rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def fingerprint(spark: SparkSession, *parts: object) -> str:
    """A name for input, options and seeds: equal parts give equal names in any session.

    A DataFrame counts by its plan and the names, lengths and modification times of the files it reads. Rows
    that come from no file can't be told apart, so such a DataFrame never equals another; name a
    version instead.
    """
    told = []
    for part in parts:
        if not isinstance(part, DataFrame):
            told.append(repr(part))
            continue
        # Spark cuts long column lists short in a plan's plain text; here every column counts.
        plan = part._jdf.queryExecution().analyzed().treeString(True, False, 2**31 - 1, False, False)
        files = sorted(part.inputFiles())
        if not files or re.search(r"Local(Relation|TableScan)|LogicalRDD|ExternalRDD", plan):
            told.append(uuid.uuid4().hex)
            continue
        told.append(repr((re.sub(r"#\d+L?", "", plan), _facts_of(spark, files))))
    return hashlib.sha256("|".join(told).encode()).hexdigest()[:24]


def _facts_of(spark: SparkSession, files: Sequence[str]) -> list[tuple]:
    """(file, length, modification time), one request per folder instead of one per file."""
    by_folder: dict[str, list[str]] = {}
    for f in files:
        folder, _, _ = f.rpartition("/")
        by_folder.setdefault(folder, []).append(f)
    told = []
    for folder, own in by_folder.items():
        place, fs = _path(spark, folder)
        wanted = {_path(spark, f)[0].getName(): f for f in own}
        told += [(wanted[x.getPath().getName()], x.getLen(), x.getModificationTime()) for x in fs.listStatus(place) if x.getPath().getName() in wanted]
    return sorted(told)


_MARKER = "_published_"


def _published(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """(number of the last marker, folder of the last whole build) of a stage."""
    place, fs = _path(spark, path)
    if not fs.exists(place):
        return 0, None
    names = [f.getPath().getName() for f in fs.listStatus(place)]
    numbers = sorted((int(n.removeprefix(_MARKER)) for n in names if n.startswith(_MARKER)), reverse=True)
    for number in numbers:
        stream = fs.open(_path(spark, f"{path}/{_MARKER}{number}")[0])
        try:
            build = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        if build and fs.exists(_path(spark, f"{path}/{build}/_SUCCESS")[0]):
            return numbers[0], f"{path}/{build}"
    return max(numbers, default=0), None


def _publish(spark: SparkSession, path: str, build: str, number: int) -> bool:
    """Name the build in the marker of that number; False if another builder has taken the number."""
    marker, fs = _path(spark, f"{path}/{_MARKER}{number}")
    try:
        stream = fs.create(marker, False)
    except Exception as e:
        if "AlreadyExists" in str(e) or "already exists" in str(e):
            return False
        raise
    stream.write(bytearray(build.encode()))
    stream.close()
    return True


def stage_path(spark: SparkSession, name: str, key: str = "") -> str:
    return f"{shared_dir(spark)}/stages/{name}" + (f"/{key}" if key else "")


def stage(
    spark: SparkSession,
    name: str,
    build: Callable[[], DataFrame],
    *partition_by: str,
    key: str | None = None,
    fresh: bool = False,
) -> DataFrame:
    """A named stage table in the shared folder, built once for what ``key`` stands for
    and read back afterwards, by later sessions too: a restarted job goes on from its stages, and losing
    an executor costs a re-read.

    ``key`` is a ``fingerprint`` of input, options and seed, or a version; without it
    the built DataFrame is fingerprinted. ``fresh`` builds anew. Rebalancing evens out the
    files: few when the table is small, split when it is not.

    A build goes to a folder of its own and counts once a marker names it. Numbers of markers are taken once, so of two builders
    the first to end is read by both; a build that breaks off, or a new one that does, leaves the last whole one in place.
    """
    built = build() if key is None else None
    path = stage_path(spark, name, key if built is None else fingerprint(spark, built, partition_by))
    number, found = _published(spark, path)
    if fresh or found is None:
        table = build() if built is None else built
        own = f"build_{uuid.uuid4().hex}"
        write_table(table.hint("rebalance", *partition_by), f"{path}/{own}", partition_by=partition_by)
        _publish(spark, path, own, number + 1)
        _, found = _published(spark, path)
    return spark.read.parquet(found)


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """The rows as an unnamed table in the shared folder: plans start anew from it, and losing an executor costs a re-read."""
    path = f"{shared_dir(df.sparkSession)}/scratch/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stages(spark: SparkSession, name: str) -> None:
    """Remove a stage, or all stages below a name, whatever their keys."""
    place, fs = _path(spark, stage_path(spark, name))
    fs.delete(place, True)
